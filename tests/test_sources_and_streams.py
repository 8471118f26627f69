import json
from datetime import timedelta

from pyspark.sql import functions as F

from fathomgrid.operators.synthesis import grid_quality
from fathomgrid.sources import readers as I
from fathomgrid.sources import sinks as O
from fathomgrid.streaming import review as W


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"part": "A", "n": 1}))
    (tmp_path / "b.json").write_text('{"part": ')
    assert rows(I.json_folder(spark, str(tmp_path), "part string, n int").filter("part is not null"), "part", "n") == [("A", 1)]
    lines = spark.createDataFrame([('{"id": "x", "w": 2}',), ("not json",)], "blob string")
    good, bad = I.blobs(lines, "blob", "id STRING, w INT")
    assert rows(good, "id", "w") == [("x", 2)] and rows(bad, "blob") == [("not json",)]


def test_tables(spark):
    md = spark.createDataFrame([(1, "intro\n| A | B |\n|---|:-:|\n| 1 | 2 |\n| 3 |  |\nend"), (2, "none")], "id int, t string")
    cells = I.markdown_cells(md, "id", "t")
    assert rows(cells, "row", "col", "text") == [(0, 0, "A"), (0, 1, "B"), (1, 0, "1"), (1, 1, "2"), (2, 0, "3"), (2, 1, "")]
    assert rows(grid_quality(cells), "score") == [(1.0,)]
    html = spark.createDataFrame([(7, "<table><tr><th colspan=2>H</th></tr><tr><td rowspan=2>a</td><td>b <i>c</i></td></tr><tr><td>d</td></tr></table>"), (8, None)], "id int, h string")
    odd = spark.createDataFrame([(1, "<td>out</td><table><tr><td rowspan=x colspan=0>a<td>b<table><th>in</table>c<tr><td>d</table><table><tr><td>second</td></tr>"), (2, "<table></table>"), (3, "")], "id int, h string")
    assert rows(I.html_cells(odd, "id", "h"), "table", "row", "col", "text", "rowspan", "colspan") == [(0, 0, 0, "a", 1, 1), (0, 0, 1, "bc", 1, 1), (0, 1, 0, "d", 1, 1), (1, 0, 0, "in", 1, 1), (2, 0, 0, "second", 1, 1)]
    two = spark.createDataFrame([(1, "| a |\n|---|\n| 1 |\n\n| b |\n| 2 |")], "id int, t string")
    assert rows(I.markdown_cells(two, "id", "t"), "table", "row", "text") == [(0, 0, "a"), (0, 1, "1"), (1, 0, "b"), (1, 1, "2")]
    assert rows(I.html_cells(html, "id", "h"), "row", "col", "text", "is_header", "rowspan", "colspan") == [(0, 0, "H", True, 1, 2), (1, 0, "a", False, 2, 1), (1, 1, "b c", False, 1, 1), (2, 1, "d", False, 1, 1)]


def test_libraries(spark):
    sym = '(kicad_symbol_lib (symbol "AMP" (property "Reference" "U") (symbol "AMP_1_1" (pin input line (name "IN \\"+\\"") (number "1")) (pin output line (name "OUT") (number "2")))'
    df = spark.createDataFrame([("p", sym), ("q", None)], "path string, body string")
    assert rows(I.symbol_pins(df, "path", "body"), "symbol", "pin_number", "pin_name", "pin_type") == [("AMP", "1", 'IN "+"', "input"), ("AMP", "2", "OUT", "output")]
    fp = '(footprint "R" (fp_line (start -1 -2) (end 1 -2) (layer "F.CrtYd")) (fp_line (start -1 -2) (end -1 2) (layer "F.CrtYd")) (fp_line (start -9 0) (end 9 0) (layer "F.SilkS"))) (footprint "E")'
    df = spark.createDataFrame([("p", fp)], "path string, body string")
    assert rows(I.footprint_boxes(df, "path", "body"), "footprint", "width", "height", "needs_review") == [("E", 0.0, 0.0, True), ("R", 2.0, 4.0, False)]
    parts = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "name string, v int, path string")
    assert rows(I.library_map(parts, "name", "v"), "path") == [("new",)]


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([(1, "corrected"), (2, "pending")], "item_id int, status string")
    O.export_corrected(items, str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out")), "item_id") == [(1,)]
    nets = spark.createDataFrame([("d", "N", "U1", "2"), ("d", "N", "C1", "1"), ("d", "A", "U1", "1")], "design_id string, net_name string, ref string, pin_number string")
    text = O.netlist_text(nets).first().value
    assert text.index('"A"') < text.index('"N"') and "(node (ref C1) (pin 1))" in text and text.count("(") == text.count(")")
    O.write_text(O.netlist_text(nets), str(tmp_path / "nets"))
    bom = spark.createDataFrame([("d", "U1", "ldo", None, 0.5)], "design_id string, ref string, component_type string, part string, confidence double")
    found = spark.createDataFrame([("d", "WARNING", "w", "x"), ("d", "CRITICAL", "c", "y")], "design_id string, severity string, rule string, subject string")
    report = O.report_text(bom, found).first().value
    assert report.index("CRITICAL") < report.index("WARNING") and "Confidence 0.5000" in report


EVENT = "item_id string, design_id string, stage string, status string, payload string, created_at timestamp, seq int"


def events(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    raw = [("a", "d", "bom", "pending", "1", at(0), 0), ("a", "d", "bom", "approved", None, at(5), 0), ("a", "d", "bom", "rejected", None, at(6), 0), ("b", "d", "bom", "pending", "2", at(3), 0), ("c", "e", "nir", "pending", "3", at(4), 0), ("c", "e", "nir", "corrected", "3b", at(4), 1)]
    return spark.createDataFrame(raw, EVENT.replace("timestamp", "string")).withColumn("created_at", __import__("pyspark.sql.functions", fromlist=["to_timestamp"]).to_timestamp("created_at"))


def test_review_states(spark):
    now = W.states(events(spark))
    assert rows(now, "item_id", "status", "payload", "refused") == [("a", "approved", None, 1), ("b", "pending", None, 0), ("c", "corrected", "3b", 0)]
    assert rows(W.latest_for_stage(now), "item_id") == [("b",), ("c",)] and [r.item_id for r in W.pending(now).collect()] == ["b"]
    wanted = spark.createDataFrame([("d", "ldo"), ("d", "adc")], "design_id string, component_type string")
    assert rows(W.missing_to_queue(wanted, wanted.limit(1), "2024-01-01 00:00:00"), "payload") == [("adc",)]


def test_review_stream(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    events(spark).repartition(2).write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema(EVENT).parquet(str(source))
        W.follow(stream, log, str(tmp_path / "check")).awaitTermination()
    assert rows(W.states(spark.read.parquet(log)), "item_id", "status") == [("a", "approved"), ("b", "pending"), ("c", "corrected")]


def test_review_lifecycle(spark, tmp_path):
    """Batches of a stream, a restart between them, refused transitions and items that nobody decides in time."""
    W.use_rocksdb(spark)
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    order = events(spark).orderBy("created_at", "seq")
    for part, due in (("minute(created_at) < 5", None), ("minute(created_at) >= 5", None)):
        order.filter(part).coalesce(1).write.mode("append").parquet(source)
        W.keep_states(W.lifecycle(spark.readStream.schema(order.schema).parquet(source), due), log, check).awaitTermination()
    want = W.states(events(spark)).select("item_id", "design_id", "status", "payload", "decided_at", "refused")
    assert rows(W.current_states(spark, log), *want.columns) == rows(want, *want.columns)

    source, log, check = (str(tmp_path / n) for n in ("in2", "log2", "check2"))
    late = spark.createDataFrame([("z", "d", "bom", "pending", "9", "2024-01-02 00:00:00", 0), ("b", "d", "bom", "approved", "4", "2024-01-02 01:00:00", 0)], EVENT.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
    for part in (order, late.filter("item_id = 'z'"), late.filter("item_id = 'b'")):
        part.coalesce(1).write.mode("append").parquet(source)
        W.keep_states(W.lifecycle(spark.readStream.schema(order.schema).parquet(source), timedelta(minutes=10), "1 minute"), log, check).awaitTermination()
    assert rows(W.current_states(spark, log), "item_id", "status", "refused") == [("a", "approved", 1), ("b", "expired", 1), ("c", "corrected", 0), ("z", "expired", 0)]


def test_windowed_stream(spark):
    out = W.windowed_counts(events(spark), "created_at", "status", size="5 minutes")
    assert ("pending", 3) in rows(out, "status", "n")
