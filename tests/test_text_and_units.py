import pytest
from pyspark.sql import functions as F

from fathomgrid.functions import text as T
from fathomgrid.functions import units as U
from fathomgrid.functions.blocks import block_ratio


def each(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_numbers_and_units(spark):
    assert each(spark, ["3.3", "1,000", "1.5k", "2M", "10 µ", "abc 7 x", "none", None, "-4e2"], U.number) == [3.3, 1000.0, 1500.0, 2e6, pytest.approx(1e-5), 7.0, None, None, -400.0]
    got = each(spark, ["3.3V", "-40 °C", "10 kΩ", "4.7pf", "100nF", "2.4GHz", "5 kohm", "3 parsec", "V", None, "20 us"], U.quantity)
    assert [(g and (pytest.approx(g.value), g.unit, g.known)) for g in got] == [(3.3, "V", True), (-40.0, "°C", True), (1e4, "Ω", True), (4.7e-12, "F", True), (1e-7, "F", True), (2.4e9, "Hz", True), (5e3, "Ω", True), (3.0, "parsec", False), None, None, (2e-5, "s", True)]


def test_classifiers(spark):
    assert each(spark, ["Electrical Characteristics", "ABSOLUTE MAXIMUM RATINGS", "Pin Configuration", "Switching Characteristics", "Ordering Information", "PCB Layout", "Foreword", None], T.section) == ["ELECTRICAL_CHARACTERISTICS", "ABSOLUTE_MAXIMUM_RATINGS", "PINOUT", "TIMING", "ORDERING", "LAYOUT_RECOMMENDATIONS", "OTHER", "OTHER"]
    assert [tuple(x) for x in each(spark, ["DRLR (SOT-23-5)", "8-pin SOIC", "DIP-8", "Unknown XYZ-99", None], T.package)] == [("SOT-23-5", False), ("SOIC-8", False), ("DIP-8", False), ("Unknown XYZ-99", True), ("", True)]
    got = each(spark, ["design a 3.3V LDO", "a buck-boost regulator", "buck converter and low-pass filter", "nothing here"], T.topologies)
    assert [[(t.name, t.confidence) for t in g] for g in got] == [[("ldo", 0.75)], [("buck_boost", 0.9)], [("buck_converter", 0.75), ("rc_lowpass", 0.75)], []]
    assert each(spark, ["Buck with LDO"], T.topologies)[0][0].confidence == 0.6
    df = spark.createDataFrame([("2.4GHz patch antenna", "standard_SMD"), ("a buck for an adc", "power_management"), ("plain board", "standard_SMD"), ("adc with battery", "through_hole")], "p string, m string")
    assert [tuple(r.x) for r in df.select(T.methodology(F.col("p"), F.col("m")).alias("x")).collect()] == [("RF_highfreq", True), ("power_management", False), ("standard_SMD", False), ("mixed_signal", True)]


def test_pins(spark):
    pins = spark.createDataFrame([("a", "VDD"), ("a", "gpio3"), ("a", "NRST"), ("a", "EN_L"), ("b", "CLK"), ("b", "SDA"), ("c", "CLK"), ("c", "MOSI"), ("d", "CLK"), ("e", "DATA"), ("e", "TX"), ("b", "WAT")], "component_id string, raw_name string")
    aliases = spark.createDataFrame([("VDD", "POWER_POSITIVE"), ("GPIO", "GPIO"), ("RST", "RESET"), ("EN", "ENABLE")], "alias string, function string")
    got = {(r.component_id, r.raw_name): (r.canonical, r.confidence) for r in T.normalise_pins(pins, aliases).collect()}
    assert got["a", "VDD"] == ("POWER_POSITIVE", 1.0) and got["a", "gpio3"] == ("GPIO", 1.0) and got["a", "NRST"] == ("RESET", 1.0) and got["a", "EN_L"] == ("ENABLE", 1.0)
    assert got["b", "CLK"] == ("I2C_CLOCK", 0.9) and got["c", "CLK"] == ("SPI_CLOCK", 0.9) and got["d", "CLK"] == (None, 0.0)
    assert got["e", "DATA"] == ("UART_RECEIVE", 0.9) and got["b", "WAT"] == (None, 0.0)
    more = spark.createDataFrame([("f", "NCS"), ("f", "MISO"), ("f", "IRQ"), ("f", "!EN"), ("f", "NRESET2"), ("g", "CS")], "component_id string, raw_name string")
    got = {(r.component_id, r.raw_name): r.canonical for r in T.normalise_pins(more, aliases.limit(0)).collect()}
    assert [got["f", n] for n in ("NCS", "MISO", "IRQ", "!EN", "NRESET2")] == ["SPI_CHIP_SELECT", None, "INTERRUPT", "ENABLE_ACTIVE_LOW", "RESET"] and got["g", "CS"] is None


def test_small_functions(spark):
    assert each(spark, ["3.3V LDO", "no volts"], T.supply_net) == ["VCC_3p3V", "VCC"]
    assert each(spark, ["U1.3", "pin 4", "board edge", "C3"], T.relative_kind) == ["pin", "pin", "board_edge", "component"]
    assert each(spark, ["  Low-Noise LDO!! "], T.slug) == ["low_noise_ldo"]
    assert each(spark, ["Low noise_low  amp"], T.goal_words) == [["low", "noise", "amp"]]
    assert each(spark, ["Place C1 close to the pin of U1. The sky is blue today."], T.placement_sentences) == [["Place C1 close to the pin of U1"]]
    assert each(spark, ["<p>multi-\n  line <b>x</b></p><script>1<2</script><!-- a > b -->"], T.clean_html) == ["multiline x"]
    assert each(spark, ["from 12V to 3.3V at 500mA and 2.4GHz"], T.parse_prompt)[0].asDict() == {"supply_v": 12.0, "output_v": 3.3, "current_ma": 500.0, "frequency_hz": 2.4e9}
    open_ = lambda goal, app, method, hz: [x.field for x in spark.createDataFrame([(goal, app, method, hz)], "g string, a string, m string, f double").select(T.ambiguities(F.col("g"), F.col("a"), F.col("m"), F.col("f")).alias("x")).first().x]
    assert open_("my_circuit", "unspecified", "RF_highfreq", None) == ["goal", "application", "frequency"] and open_("patch_antenna", "drone", "RF_highfreq", 2.4e9) == []
    d = each(spark, ["Please design a low power LoRa sensor, 4 layer board", "nothing"], T.parse_design)
    assert (d[0].goal, d[0].method, d[0].application, d[0].board, d[0].constraints) == ("a_low_power_lora", "RF_highfreq", "iot sensor", "4_layer", ["low_power"])
    assert (d[1].goal, d[1].method, d[1].application, d[1].board, d[1].constraints) == ("circuit", "standard_SMD", "unspecified", "double_sided_SMD", [])
    assert each(spark, ["Requires ", "is a", "zzz"], lambda c: T.mapped(c, {"requires": "REQUIRES", "is a": "IS_A"})) == ["REQUIRES", "IS_A", None]
    df = spark.createDataFrame([("kitten", "sitting", {"v": "3.3 V", "t": ""}, "a 3.3V part")], "a string, b string, m map<string,string>, q string")
    r = df.select(block_ratio("a", "b").alias("r"), T.matching_properties(F.col("m"), F.col("q")).alias("k")).first()
    assert r.r == pytest.approx(2 * 4 / 13) and r.k == ["v"]


def test_goals_and_roles(spark):
    assert each(spark, ["a_3_3v_ldo", "a_2_4ghz_patch", "the", "buck", "low-noise_preamp_for_the", "build_a_very_long_goal_name_here"], T.clean_goal) == ["ldo_regulator", "patch_antenna", "unknown", "buck_converter", "low_noise_preamp", "very_long_goal_name"]
    assert each(spark, ["POWER_GROUND", "GPIO", "odd"], T.role) == ["GROUND", "BIDIRECTIONAL", None]
    df = spark.createDataFrame([(["spi1_sck", "MOSI", "led"],)], "n array<string>")
    got = df.select(T.alternate_functions(F.col("n"), {"MOSI": "SPI_DATA_IN"}).alias("x")).first().x
    assert [tuple(g) for g in got] == [("spi1_sck", "SPI1"), ("SPI_DATA_IN", None), ("led", None)]


def test_a_unit_is_worked_out_once(spark):
    df = spark.createDataFrame([("3.3 kΩ",), ("7 furlong",), ("x",)], "t string").select(U.quantity(F.col("t")).alias("q"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    assert [r.q and tuple(r.q) for r in df.collect()] == [(3300.0, "Ω", True), (7.0, "furlong", False), None]
