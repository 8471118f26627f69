"""Registered queries over derived circuit tables: pins, nets, bills of material, notes and graphs.

The fixture tables have no circuits, so each query makes its input by a piece of SQL that
both engines read (tables in braces), runs a library operator on it, and compares with
SQL over the same piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.functions import text as T
from fathomgrid.operators import aggregates as A
from fathomgrid.operators import graph as G
from fathomgrid.operators import joins as J
from fathomgrid.operators import knowledge as N
from fathomgrid.operators import ranking as R
from fathomgrid.operators import relational as L
from fathomgrid.operators import retrieval as V
from fathomgrid.operators import rules as K
from fathomgrid.operators import synthesis as S
from fathomgrid.operators import topologies as Y
from fathomgrid.registry import query
from fathomgrid.session import load, load_in_order

TABLES = ("customer", "documents", "events", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


def made(spark: SparkSession, sf: str, piece: str) -> DataFrame:
    """The rows of a piece of SQL."""
    rows = spark.sql(piece, **{t: load(spark, sf, t) for t in TABLES if "{" + t + "}" in piece})
    return rows.withColumns({f.name: F.col(f.name).cast("double") for f in rows.schema if f.dataType.typeName() == "decimal"})


def duck(sql: str, **pieces: str) -> str:
    """The SQL with its pieces as common tables."""
    named = ", ".join(f"{name} AS ({piece})" for name, piece in pieces.items())
    for t in TABLES:
        named = named.replace("{" + t + "}", t)
    return f"WITH {named} {sql}" if not sql.startswith(",") else f"WITH {named}{sql}"


# Nets and pins

_SPOT = "(l_orderkey + l_linenumber) % 9"
NETS = f"""SELECT DISTINCT 'd' || CAST(l_orderkey % 50 AS STRING) AS design_id,
CASE {_SPOT} WHEN 0 THEN 'GND' WHEN 1 THEN 'VCC_3V3_5V' WHEN 2 THEN 'VCC' WHEN 3 THEN 'AGND' ELSE 'N' || CAST((l_orderkey * 3 + l_linenumber) % 23 AS STRING) END AS net_name,
CASE WHEN {_SPOT} <= 3 THEN 'power' ELSE 'signal' END AS net_type, 'U' || CAST(l_partkey % 12 AS STRING) AS ref, CAST(l_linenumber AS STRING) AS pin_number,
CASE l_linenumber WHEN 1 THEN 'VOUT' WHEN 2 THEN 'VCC' ELSE 'X' END AS pin_name FROM {{lineitem}}"""
PINS = """SELECT design_id, 'U' || CAST(k AS STRING) AS ref, CAST(pin AS STRING) AS pin_number,
CASE WHEN h IN (0, 1) THEN 'output' WHEN h = 2 THEN 'io' WHEN h IN (3, 4) THEN 'input' ELSE 'power' END AS pin_type,
CASE h WHEN 5 THEN 'POWER_POSITIVE' WHEN 6 THEN 'POWER_GROUND' WHEN 7 THEN 'ENABLE' WHEN 8 THEN 'POWER_INPUT' END AS function,
CASE h WHEN 0 THEN 'SIGNAL_OUT' WHEN 1 THEN 'ANALOG_OUT' WHEN 2 THEN 'NC' WHEN 3 THEN 'SIGNAL_IN' WHEN 4 THEN 'SENSE_POS' WHEN 5 THEN 'POWER_OUT' WHEN 6 THEN 'GROUND' WHEN 7 THEN 'ENABLE' WHEN 8 THEN 'POWER_IN' END AS role
FROM (SELECT design_id, k, pin, (k * 7 + pin) % 11 AS h FROM (SELECT DISTINCT 'd' || CAST(l_orderkey % 50 AS STRING) AS design_id, l_partkey % 12 AS k, l_linenumber + 2 * (l_suppkey % 2) AS pin FROM {lineitem}))"""
BOM = """SELECT design_id, 'U' || CAST(k AS STRING) AS ref, k AS pos,
CASE k WHEN 0 THEN 'ldo_regulator' WHEN 1 THEN 'adc_converter' WHEN 2 THEN 'microcontroller' WHEN 3 THEN 'op_amp' WHEN 4 THEN 'bypass_capacitor' WHEN 5 THEN 'power_inductor' WHEN 6 THEN 'pull_up_resistor' WHEN 7 THEN 'buck_converter' WHEN 8 THEN 'wifi_module' ELSE 'connector' END AS component_type,
CASE WHEN k % 5 <> 4 THEN 'P' || CAST((k + n) % 9 AS STRING) END AS part, ((k * 13 + n * 7) % 100) / 100.0 AS confidence, 'near C' || CAST(k AS STRING) || ' of the board' AS justification
FROM (SELECT DISTINCT 'd' || CAST(l_orderkey % 50 AS STRING) AS design_id, l_partkey % 12 AS k, l_orderkey % 50 AS n FROM {lineitem})"""
_ON = "o AS (SELECT n.*, p.pin_type, p.function, p.role FROM nets n LEFT JOIN pins p USING (design_id, ref, pin_number))"
_CHECKED = "checked AS (SELECT design_id, sum(CASE WHEN net_type = 'power' THEN 3 ELSE 2 END) AS checked FROM (SELECT DISTINCT design_id, net_name, net_type FROM nets) GROUP BY 1)"

_ERC = f""", {_ON},
p AS (SELECT design_id, net_name, net_type, count(*) FILTER (pin_type IN ('output', 'io')) AS outs, count(DISTINCT ref) FILTER (pin_type IN ('output', 'io')) AS drivers,
  bool_or(coalesce(function = 'POWER_POSITIVE', false)) AS sourced, count(*) FILTER (pin_type IN ('input', 'io') AND coalesce(function NOT IN ('POWER_POSITIVE', 'POWER_GROUND', 'POWER_INPUT'), true)) AS ins FROM o GROUP BY ALL),
found AS (SELECT design_id, 'no_output_conflict' AS rule, net_name AS subject FROM p WHERE outs > 1
UNION ALL SELECT design_id, 'power_net_has_source', net_name FROM p WHERE net_name LIKE 'VCC%' AND NOT sourced
UNION ALL SELECT design_id, 'no_required_pin_floating', ref || '.' || pin_number FROM pins WHERE function IN ('POWER_POSITIVE', 'POWER_GROUND', 'ENABLE', 'RESET') AND (design_id, ref, pin_number) NOT IN (SELECT design_id, ref, pin_number FROM nets)
UNION ALL SELECT design_id, 'no_logic_level_mismatch', net_name FROM p WHERE net_name LIKE '%3V3%' AND net_name LIKE '%5V%'
UNION ALL SELECT design_id, 'no_floating_inputs', net_name FROM p WHERE net_type <> 'power' AND drivers = 0 AND ins > 0)"""


def _erc(spark, sf, *rules):
    found = K.electrical_checks(made(spark, sf, NETS), made(spark, sf, PINS))
    return found.filter(F.col("rule").isin(*rules)).select("design_id", "rule", "subject")


@query(duck(_ERC + " SELECT design_id, rule, subject FROM found WHERE rule = 'no_required_pin_floating'", nets=NETS, pins=PINS))
def c16_floating_pins(spark, sf):
    return _erc(spark, sf, "no_required_pin_floating")


@query(duck(_ERC + " SELECT design_id, rule, subject FROM found WHERE rule IN ('no_output_conflict', 'power_net_has_source')", nets=NETS, pins=PINS))
def c7_pins_on_nets(spark, sf):
    return _erc(spark, sf, "no_output_conflict", "power_net_has_source")


@query(duck(_ERC + " SELECT design_id, rule, subject FROM found WHERE rule = 'no_logic_level_mismatch'", nets=NETS, pins=PINS))
def k9_mixed_levels(spark, sf):
    return _erc(spark, sf, "no_logic_level_mismatch")


@query(duck(_ERC + " SELECT design_id, rule, subject FROM found WHERE rule IN ('no_required_pin_floating', 'no_floating_inputs')", nets=NETS, pins=PINS))
def k8_floating(spark, sf):
    return _erc(spark, sf, "no_required_pin_floating", "no_floating_inputs")


_ROLES = f""", {_ON}, {_CHECKED},
sized AS (SELECT design_id, net_name, net_type, count(*) AS n, count(role) AS known, bool_or(role IN ('POWER_OUT', 'GROUND')) AS driven FROM o GROUP BY ALL),
found AS (SELECT design_id, 'CRITICAL' AS severity, 'driver_conflict' AS rule, net_name || ':' || role AS subject FROM o WHERE role IN ('POWER_OUT', 'SIGNAL_OUT', 'ANALOG_OUT') GROUP BY design_id, net_name, role HAVING count(*) > 1
UNION ALL SELECT design_id, 'CRITICAL', 'nc_connected', ref || '.' || pin_number FROM o JOIN sized USING (design_id, net_name) WHERE role = 'NC' AND n > 1
UNION ALL SELECT design_id, 'WARNING', 'power_undriven', net_name FROM sized WHERE net_type = 'power' AND known > 0 AND NOT coalesce(driven, false))"""


@query(duck(_ROLES + " SELECT design_id, severity, rule, subject FROM found", nets=NETS, pins=PINS))
def k11_role_compatibility(spark, sf):
    return K.role_checks(made(spark, sf, NETS), made(spark, sf, PINS))[0].select("design_id", "severity", "rule", "subject")


_TEMPLATE = """, needs AS (SELECT design_id, ref, role FROM bom JOIN (VALUES ('ldo_regulator', 'POWER_IN'), ('ldo_regulator', 'GROUND'), ('ldo_regulator', 'POWER_OUT'), ('adc_converter', 'POWER_IN'), ('adc_converter', 'GROUND'), ('adc_converter', 'ANALOG_IN'),
  ('microcontroller', 'POWER_IN'), ('microcontroller', 'GROUND'), ('op_amp', 'POWER_IN'), ('op_amp', 'SIGNAL_OUT'), ('buck_converter', 'POWER_IN'), ('buck_converter', 'GROUND'), ('buck_converter', 'POWER_OUT')) t(component_type, role) USING (component_type) WHERE (design_id, ref) IN (SELECT design_id, ref FROM pins)),
have AS (SELECT design_id, ref, role, bool_or((design_id, ref, pin_number) IN (SELECT design_id, ref, pin_number FROM nets)) AS linked FROM pins WHERE role IS NOT NULL GROUP BY ALL),
found AS (SELECT design_id, ref, role, linked FROM needs LEFT JOIN have USING (design_id, ref, role) WHERE NOT coalesce(linked, false))"""


@query(duck(_TEMPLATE + " SELECT design_id, CASE WHEN linked IS NULL THEN 'role_missing' ELSE 'role_unconnected' END AS rule, ref || ':' || role AS subject FROM found", nets=NETS, pins=PINS, bom=BOM))
def k12_required_roles(spark, sf):
    return K.template_checks(made(spark, sf, NETS), made(spark, sf, PINS), made(spark, sf, BOM))[0].select("design_id", "rule", "subject")


@query(
    duck(
        f""", {_ON}, kinds AS (SELECT design_id, ref, component_type IN ('op_amp', 'adc_converter') AS a, component_type = 'microcontroller' AS d FROM bom)
SELECT design_id, 'many_grounds' AS rule, CAST(count(DISTINCT net_name) AS VARCHAR) AS subject FROM o WHERE role = 'GROUND' GROUP BY design_id HAVING count(DISTINCT net_name) > 3
UNION ALL SELECT DISTINCT a.design_id, 'kelvin_short:' || a.ref, a.net_name FROM o a JOIN o b USING (design_id, ref, net_name) WHERE a.role IN ('SENSE_POS', 'SENSE_NEG') AND b.role = 'POWER_OUT'
UNION ALL SELECT design_id, 'shared_ground', net_name FROM o JOIN kinds USING (design_id, ref) WHERE role = 'GROUND' GROUP BY ALL HAVING bool_or(a) AND bool_or(d)""",
        nets=NETS, pins=PINS, bom=BOM,
    )
)
def k14_power_invariants(spark, sf):
    found = K.ground_checks(made(spark, sf, NETS), made(spark, sf, PINS), made(spark, sf, BOM))
    return found.select("design_id", F.when(F.col("rule") == "kelvin_short", F.concat_ws(":", "rule", F.col("refs")[0])).otherwise(F.col("rule")).alias("rule"), "subject")


_PLACES = "SELECT DISTINCT 'd' || CAST(l_orderkey % 50 AS STRING) AS design_id, 'U' || CAST(l_suppkey % 14 AS STRING) AS ref FROM {lineitem}"


@query(
    duck(
        """, c AS (SELECT design_id, ref, CASE WHEN pos = 3 THEN 0.0 ELSE 0.5 END AS datasheet_confidence FROM bom WHERE pos <> 11),
p AS (SELECT design_id, net_name, net_type, count(*) AS n, count(*) FILTER (pin_name IN ('VOUT', 'VCC')) AS sources FROM nets GROUP BY ALL)
SELECT design_id, 'unknown_net_ref' AS rule, net_name || '/' || ref AS subject FROM nets WHERE (design_id, ref) NOT IN (SELECT design_id, ref FROM c)
UNION ALL SELECT design_id, 'unknown_placement_ref', ref || '/' || ref FROM places WHERE (design_id, ref) NOT IN (SELECT design_id, ref FROM c)
UNION ALL SELECT design_id, 'single_pin_net', net_name FROM p WHERE net_type <> 'power' AND n < 2
UNION ALL SELECT design_id, 'power_without_source', net_name FROM p WHERE net_type = 'power' AND sources = 0
UNION ALL SELECT design_id, 'power_with_many_sources', net_name FROM p WHERE net_type = 'power' AND sources > 1
UNION ALL SELECT design_id, 'zero_confidence', ref || '/' || ref FROM c WHERE datasheet_confidence = 0""",
        nets=NETS, bom=BOM, places=_PLACES,
    )
)
def k15_netlist_validation(spark, sf):
    parts = made(spark, sf, BOM).filter("pos <> 11").select("design_id", "ref", F.when(F.col("pos") == 3, 0.0).otherwise(0.5).alias("datasheet_confidence"))
    found = K.netlist_checks(parts, made(spark, sf, NETS), made(spark, sf, _PLACES))
    return found.select("design_id", "rule", F.concat_ws("/", "subject", "refs").alias("subject"))


_STOCK = "SELECT DISTINCT 'P' || CAST(p_partkey % 9 AS STRING) AS part, CASE p_partkey % 9 WHEN 0 THEN 'obsolete' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'active' ELSE 'unknown' END AS status FROM {part} WHERE p_partkey % 9 < 6"
_LEVELS = "SELECT design_id, pos, ref, component_type, part, CASE WHEN pos % 4 = 3 THEN 'adj' ELSE CAST(pos AS STRING) END AS volts FROM ({bom_piece})".replace("{bom_piece}", BOM)


@query(
    duck(
        """, v AS (SELECT *, try_cast(volts AS DOUBLE) AS v FROM bom)
SELECT a.design_id, 'voltage_conflict' AS rule, a.ref || '/' || b.ref AS subject FROM v a JOIN v b ON a.design_id = b.design_id AND a.pos < b.pos AND abs(a.v - b.v) > 0.1 WHERE a.component_type LIKE '%converter' AND b.component_type LIKE '%converter'
UNION ALL SELECT a.design_id, 'logic_mismatch', a.ref || '/' || b.ref FROM v a JOIN v b ON a.design_id = b.design_id AND a.pos < b.pos AND abs(a.v / 4 - b.v / 4) > 0.5 WHERE a.component_type = 'connector' AND b.component_type = 'connector'
UNION ALL SELECT design_id, 'not_available', part FROM bom JOIN stock USING (part) WHERE status IN ('obsolete', 'unavailable')""",
        bom=_LEVELS, stock=_STOCK,
    )
)
def k16_bom_validation(spark, sf):
    quarter = F.expr("CAST(try_cast(volts AS DOUBLE) / 4 AS STRING)")
    bom = made(spark, sf, _LEVELS).withColumn("constraints", F.create_map(F.lit("output_voltage"), F.col("volts"), F.lit("logic_voltage"), quarter))
    found = K.bom_checks(bom, made(spark, sf, _STOCK), F.endswith("component_type", F.lit("converter")), F.col("component_type") == "connector")
    return found.select("design_id", "rule", "subject")


@query(duck("SELECT design_id, coalesce(avg(confidence) < 0.85, true) OR bool_or(confidence < 0.75) OR bool_or(part IS NULL) AS review FROM bom GROUP BY 1", bom=BOM))
def k17_bom_review(spark, sf):
    bom = made(spark, sf, BOM)
    return K.bom_review(bom, bom.groupBy("design_id").agg(F.avg("confidence").alias("score")))


_LIMITS = "SELECT l_partkey AS component_id, CASE l_linenumber % 3 WHEN 0 THEN 'Supply Voltage max' WHEN 1 THEN 'Input_Current_abs_max' ELSE 'noise' END AS parameter_name, max(l_quantity) AS value_max FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1, 2"
_USED = "SELECT l_partkey AS component_id, CASE l_linenumber % 3 WHEN 0 THEN 'supply voltage' WHEN 1 THEN 'INPUT_CURRENT ' ELSE 'noise' END AS parameter_name, max(l_quantity) AS value_max FROM {lineitem} WHERE l_returnflag <> 'R' GROUP BY 1, 2"


@query(duck(", a AS (SELECT component_id, CASE WHEN parameter_name LIKE 'Supply%' THEN 'supply voltage' WHEN parameter_name LIKE 'Input%' THEN 'input_current' ELSE 'noise' END AS name, value_max AS absolute_max FROM limits), u AS (SELECT component_id, lower(trim(parameter_name)) AS name, value_max AS operating_max FROM used) SELECT component_id, name, operating_max, absolute_max FROM u JOIN a USING (component_id, name) WHERE operating_max > absolute_max", limits=_LIMITS, used=_USED))
def c20_absolute_limits(spark, sf):
    return K.limits_exceeded(made(spark, sf, _USED), made(spark, sf, _LIMITS))


_LEVEL = "SELECT l_partkey AS component_id, CASE l_linenumber WHEN 1 THEN 'V_CC' WHEN 2 THEN 'V_IL' WHEN 3 THEN 'V_IH' WHEN 4 THEN 'V_OL' ELSE 'V_OH' END AS symbol, min(l_quantity) AS value_min, max(l_quantity) AS value_max FROM {lineitem} WHERE l_linenumber <= 5 GROUP BY 1, 2"


@query(
    duck(
        """, w AS (SELECT component_id, max(value_max) FILTER (symbol = 'V_CC') AS vcc, max(value_max) FILTER (symbol = 'V_IL') AS vil, max(value_min) FILTER (symbol = 'V_IH') AS vih, max(value_max) FILTER (symbol = 'V_OL') AS vol, max(value_min) FILTER (symbol = 'V_OH') AS voh FROM level GROUP BY 1)
SELECT component_id, 'vil_below_vih' AS rule FROM w WHERE vil >= vih UNION ALL SELECT component_id, 'vol_below_voh' FROM w WHERE vol >= voh UNION ALL SELECT component_id, 'vih_within_vcc' FROM w WHERE vih > vcc UNION ALL SELECT component_id, 'voh_within_vcc' FROM w WHERE voh > vcc UNION ALL SELECT component_id, 'vol_below_vil' FROM w WHERE vol > vil""",
        level=_LEVEL,
    )
)
def c21_cross_parameters(spark, sf):
    return K.cross_checks(made(spark, sf, _LEVEL))


_NAMED = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Supply Voltage' WHEN 1 THEN 'supply current' WHEN 2 THEN 'Gain' ELSE 'output voltage' END AS name, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS value_min, CAST(p_size * 1.5 AS DOUBLE) AS value_typ, CASE WHEN p_size % 2 > 0 THEN CAST(p_size * 2 AS DOUBLE) END AS value_max FROM {part}"


@query(duck(", r AS (SELECT * FROM (VALUES (1, 'supply voltage', 0::DOUBLE, 60::DOUBLE), (2, 'supply', 0, 5), (3, 'voltage', 4, 40)) v(pos, pattern, low, high)), h AS (SELECT n.*, low, high, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM named n JOIN r ON contains(lower(name), pattern)) SELECT id, name, low, high FROM h WHERE k = 1 AND (value_min < low OR value_min > high OR value_typ < low OR value_typ > high OR value_max < low OR value_max > high)", named=_NAMED))
def k3_sanity_ranges(spark, sf):
    ranges = spark.createDataFrame([(1, "supply voltage", 0.0, 60.0), (2, "supply", 0.0, 5.0), (3, "voltage", 4.0, 40.0)], "pos int, pattern string, low double, high double")
    return K.out_of_range(made(spark, sf, _NAMED), ranges).select("id", "name", "low", "high")


_PLACED = "SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_name END AS subject, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal / 10000 END AS confidence FROM {customer}"


@query(duck("SELECT id, CASE WHEN subject IS NULL OR trim(subject) = '' THEN 'no_subject' ELSE 'low_confidence' END AS problem FROM placed WHERE subject IS NULL OR trim(subject) = '' OR confidence IS NULL OR confidence < 0.65", placed=_PLACED))
def b13_placement_problems(spark, sf):
    return K.placement_problems(made(spark, sf, _PLACED)).select("id", "problem")


# Synthesis

_FUNCTIONS = ("SPI_CLOCK", "SPI_CHIP_SELECT", "UART_TRANSMIT", "UART_RECEIVE", "POWER_POSITIVE", "POWER_GROUND", "POWER_INPUT", "I2C_DATA", "NO_CONNECT", "RF_OUTPUT")
MADE_PINS = (
    "SELECT design_id, ref, pin_number, CASE h " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FUNCTIONS)) + " END AS function, CASE WHEN h % 3 > 0 THEN h / 10.0 END AS confidence, CASE k WHEN 0 THEN '3.3V ldo' WHEN 7 THEN '5V buck' WHEN 1 THEN 'adc at 9V' ELSE 'mcu' END AS part_text "
    "FROM (SELECT DISTINCT 'd' || CAST(l_orderkey % 50 AS STRING) AS design_id, 'U' || CAST(l_partkey % 12 AS STRING) AS ref, l_partkey % 12 AS k, CAST(l_linenumber AS STRING) AS pin_number, (l_partkey % 12 + l_linenumber * 3) % 12 AS h FROM {lineitem} WHERE l_orderkey % 50 % 4 > 0 OR l_partkey % 12 <> 7)"
)
_POWER = """, many AS (SELECT design_id, count(DISTINCT ref) FILTER (part_text LIKE '%ldo%' OR part_text LIKE '%buck%') > 1 AS many FROM pins GROUP BY 1),
power AS (SELECT design_id, CASE WHEN function = 'POWER_GROUND' THEN 'GND' WHEN function = 'POWER_INPUT' THEN 'VIN' WHEN many AND part_text LIKE '3.3V%' THEN 'VCC_3p3V' WHEN many AND part_text LIKE '5V%' THEN 'VCC_5V' ELSE 'VCC' END AS net_name, 'power' AS net_type, ref, pin_number, confidence FROM pins JOIN many USING (design_id) WHERE function IN ('POWER_POSITIVE', 'POWER_GROUND', 'POWER_INPUT'))"""
_SIGNAL = """, signal AS (SELECT design_id, CASE function WHEN 'SPI_CLOCK' THEN 'SPI_SCK' WHEN 'SPI_CHIP_SELECT' THEN 'SPI_CS_' || ref WHEN 'I2C_DATA' THEN 'I2C_SDA' WHEN 'RF_OUTPUT' THEN 'RF_OUT' ELSE function END AS net_name, CASE WHEN function IN ('SPI_CLOCK', 'I2C_CLOCK') THEN 'clock' WHEN function LIKE 'RF!_%' ESCAPE '!' THEN 'RF' ELSE 'signal' END AS net_type, ref, pin_number, confidence
  FROM pins WHERE function IS NOT NULL AND function NOT IN ('NO_CONNECT', 'POWER_POSITIVE', 'POWER_GROUND', 'POWER_INPUT', 'UART_TRANSMIT', 'UART_RECEIVE')
UNION ALL SELECT t.design_id, 'UART_' || t.ref || '_' || r.ref, 'signal', unnest([t.ref, r.ref]), unnest([t.pin_number, r.pin_number]), unnest([t.confidence, r.confidence]) FROM pins t JOIN pins r ON t.design_id = r.design_id AND t.function = 'UART_TRANSMIT' AND r.function = 'UART_RECEIVE' AND t.ref <> r.ref)"""
_NET_COLUMNS = ("design_id", "net_name", "net_type", "ref", "pin_number", "confidence")


@query(duck(_POWER + " SELECT * FROM power", pins=MADE_PINS))
def d11_power_nets(spark, sf):
    return S.power_nets(made(spark, sf, MADE_PINS)).select(*_NET_COLUMNS)


@query(duck(_SIGNAL + " SELECT * FROM signal", pins=MADE_PINS))
def d12_signal_nets(spark, sf):
    return S.signal_nets(made(spark, sf, MADE_PINS)).select(*_NET_COLUMNS)


@query(duck(_SIGNAL + " SELECT design_id, net_name, ref FROM signal WHERE net_name LIKE 'UART%'", pins=MADE_PINS))
def c8_crossed_pairs(spark, sf):
    return S.signal_nets(made(spark, sf, MADE_PINS)).filter("net_name LIKE 'UART%'").select("design_id", "net_name", "ref")


@query(duck(_POWER + " SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'VCC_' || (p_size / 10) || 'p5V' WHEN p_partkey % 3 = 1 THEN 'VCC_' || p_size || 'V' ELSE 'VCC' END AS net FROM (SELECT p_partkey, p_partkey % 3 AS k, p_size // 1 AS p_size FROM part)".replace("(p_size / 10)", "(p_size // 10)"), pins=MADE_PINS))
def h27_supply_names(spark, sf):
    part = made(spark, sf, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'out ' || CAST(p_size DIV 10 AS STRING) || '.5 V' WHEN 1 THEN CAST(p_size AS STRING) || 'V supply' ELSE 'none' END AS t FROM {part}")
    return part.select("p_partkey", T.supply_net(F.col("t")).alias("net"))


@query(duck(_POWER + _SIGNAL + ", c AS (SELECT design_id, net_name, coalesce(avg(confidence), 0.5) AS c FROM (SELECT * FROM power UNION ALL SELECT * FROM signal) GROUP BY ALL) SELECT design_id, round(avg(c), 4) AS confidence FROM c GROUP BY 1", pins=MADE_PINS))
def d9_design_confidence(spark, sf):
    pins = made(spark, sf, MADE_PINS)
    return S.design_confidence(S.power_nets(pins).unionByName(S.signal_nets(pins)))


_BLOCK = """, bus AS (SELECT DISTINCT design_id, ref FROM signal WHERE regexp_matches(net_name, '^(SPI|I2C|UART)_')),
typed AS (SELECT design_id, ref, CASE WHEN regexp_matches(component_type, 'regulator|ldo|buck|boost|converter|charger') THEN 'power' WHEN regexp_matches(component_type, 'antenna|rf|bluetooth|wifi|lora|wireless') THEN 'RF' WHEN regexp_matches(component_type, 'microcontroller|mcu|processor|fpga|gate|flip') THEN 'digital' WHEN regexp_matches(component_type, 'op_amp|opamp|adc|dac|comparator|amplifier') THEN 'analog'
  WHEN regexp_matches(component_type, 'capacitor|resistor|inductor|crystal|fuse') THEN 'passive' WHEN (design_id, ref) IN (SELECT design_id, ref FROM bus) THEN 'digital' ELSE 'mixed' END AS block_type FROM bom)"""


@query(duck(_SIGNAL + _BLOCK + " SELECT design_id, block_type, string_agg(ref, ',' ORDER BY ref) AS refs FROM typed GROUP BY 1, 2", pins=MADE_PINS, bom=BOM))
def d10_blocks(spark, sf):
    found = S.blocks(made(spark, sf, BOM), S.signal_nets(made(spark, sf, MADE_PINS)))
    return found.select("design_id", "block_type", F.array_join("refs", ",").alias("refs"))


@query(duck(_SIGNAL + _BLOCK + " SELECT design_id, block_type || '_block' AS name, block_type IN ('RF', 'analog') AS isolation, count(*) AS n FROM typed GROUP BY 1, 2, 3", pins=MADE_PINS, bom=BOM))
def d28_groups(spark, sf):
    found = S.blocks(made(spark, sf, BOM), S.signal_nets(made(spark, sf, MADE_PINS)))
    return found.select("design_id", "name", "isolation", F.size("refs").cast("long").alias("n"))


_BOARDS = "SELECT 'd' || CAST(n_nationkey AS STRING) AS design_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Rogers_4003C low loss' ELSE 'FR4' END AS material FROM {nation}"


@query(duck(_SIGNAL + " SELECT DISTINCT design_id, net_name, CASE net_type WHEN 'RF' THEN 'impedance_controlled' ELSE 'isolation' END AS hint, CASE WHEN net_type = 'RF' THEN CASE WHEN material LIKE 'Rogers%' THEN 0.35 ELSE 2.0 END END AS width_mm FROM signal LEFT JOIN boards USING (design_id) WHERE net_type IN ('RF', 'clock')", pins=MADE_PINS, boards=_BOARDS))
def h40_routing_hints(spark, sf):
    return S.routing_hints(S.signal_nets(made(spark, sf, MADE_PINS)), made(spark, sf, _BOARDS)).withColumn("width_mm", F.col("width_mm").cast("decimal(3,2)"))


@query(
    duck(
        _POWER
        + """, two AS (SELECT design_id, ref, list_sort(list((pin_number, confidence))) AS p FROM pins GROUP BY 1, 2), names AS (SELECT design_id, bool_or(net_name = 'VCC') AS vcc, bool_or(net_name = 'VCC_3p3V') AS v3, bool_or(net_name = 'VCC_5V') AS v5 FROM power GROUP BY 1),
k AS (SELECT b.design_id, ref, pos, p, CASE WHEN vcc THEN 'VCC' WHEN v3 THEN 'VCC_3p3V' WHEN v5 THEN 'VCC_5V' END AS best FROM bom b LEFT JOIN two USING (design_id, ref) LEFT JOIN names USING (design_id) WHERE pos IN (4, 5, 6)),
n AS (SELECT design_id, ref, p, CASE pos WHEN 4 THEN 'VCC_C4_BYPASS' WHEN 5 THEN ref || '_L_IN' ELSE best END AS n1, CASE pos WHEN 4 THEN 'VCC_C4_BYPASS_GND' WHEN 5 THEN ref || '_L_OUT' ELSE ref || '_PULLUP' END AS n2 FROM k)
SELECT design_id, ref, n1 AS net_name, p[1][1] AS pin_number FROM n WHERE n1 IS NOT NULL AND p IS NOT NULL UNION ALL SELECT design_id, ref, n2, coalesce(p[2], p[1])[1] FROM n WHERE n1 IS NOT NULL AND p IS NOT NULL""",
        pins=MADE_PINS, bom=BOM,
    )
)
def c24_passive_nets(spark, sf):
    pins = made(spark, sf, MADE_PINS)
    return S.passive_nets(made(spark, sf, BOM), pins, S.power_nets(pins))[0].select("design_id", "ref", "net_name", "pin_number")


_SHEETS = "SELECT 'P' || CAST(p_partkey AS STRING) AS part, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS footprint, p_size / 100.0 AS datasheet_confidence FROM {part}"
_FLAGS = "SELECT DISTINCT 'd' || CAST(l_orderkey % 50 AS STRING) AS design_id, 'U' || CAST(l_partkey % 12 AS STRING) AS ref, l_linestatus || l_returnflag AS flag FROM {lineitem} WHERE l_quantity < 10"


@query(duck("SELECT design_id, ref, coalesce(footprint, 'UNKNOWN') AS footprint, coalesce(datasheet_confidence, 0.0) AS datasheet_confidence, coalesce((SELECT string_agg(flag, ',' ORDER BY flag) FROM flags f WHERE f.design_id = b.design_id AND f.ref = b.ref), '') AS flags FROM bom b LEFT JOIN sheets USING (part)", bom=BOM, sheets=_SHEETS, flags=_FLAGS))
def c5_bom_with_sheets(spark, sf):
    found = S.assemble(made(spark, sf, BOM), made(spark, sf, _SHEETS), made(spark, sf, _FLAGS))
    return found.select("design_id", "ref", "footprint", F.col("datasheet_confidence").cast("double").alias("datasheet_confidence"), F.array_join("flags", ",").alias("flags"))


_CELLS = "SELECT l_orderkey AS grid_id, l_linenumber - 1 AS row, CAST(l_suppkey % 3 AS INT) AS col, CASE WHEN l_quantity < 8 THEN ' ' WHEN l_quantity > 45 THEN NULL ELSE l_linestatus || l_returnflag END AS text, l_linenumber = 1 AND l_suppkey % 2 = 0 AS is_header FROM {lineitem}"


@query(
    duck(
        """, g AS (SELECT grid_id, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') / count(*) AS e, bool_or(is_header) AS h, max(row) + 1 AS r FROM cells GROUP BY 1)
SELECT grid_id, round((CASE WHEN n > 4 THEN 1.0 ELSE n / 4 END + CASE WHEN e < 0.3 THEN 1.0 ELSE greatest(0.0, 1.0 - (e - 0.3) * 2) END + CASE WHEN h THEN 1.0 ELSE 0.0 END + CASE WHEN r > 1 THEN 1.0 ELSE 0.0 END) * 0.25, 4) AS score FROM g""",
        cells=_CELLS,
    )
)
def d21_grid_quality(spark, sf):
    return S.grid_quality(made(spark, sf, _CELLS))


# Aggregates and ranks


@query("SELECT c_nationkey AS design_id, round(avg(v), 4) AS confidence FROM (SELECT c_nationkey, c_acctbal / 10000 AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal / 10000 FROM supplier) GROUP BY 1")
def d18_mean_of_both(spark, sf):
    customer, supplier = load(spark, sf, "customer"), load(spark, sf, "supplier")
    return A.mean_of_both(customer.select(F.col("c_nationkey").alias("design_id"), (F.col("c_acctbal") / 10000).alias("confidence")), supplier.select(F.col("s_nationkey").alias("design_id"), (F.col("s_acctbal") / 10000).alias("confidence")))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, l_discount * 4 + l_tax * 3 + l_quantity / 50 * 0.3)), 6) AS confidence FROM lineitem")
def d19_extraction_confidence(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(A.extraction_confidence(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50), 6).alias("confidence"))


_GRIDS = "SELECT l_orderkey AS k, l_linenumber AS pos, l_quantity / 50 AS confidence, CASE WHEN l_suppkey % 3 = 0 THEN 'PINOUT' WHEN l_suppkey % 3 = 1 THEN 'TIMING' ELSE 'OTHER' END AS section, l_discount = 0 AS from_model FROM {lineitem}"


@query(duck("SELECT k, round(avg(confidence), 4) AS confidence, coalesce(arg_min(section, pos) FILTER (section <> 'OTHER'), 'OTHER') AS section, bool_or(from_model) AS from_model FROM (SELECT k, pos, confidence, section, from_model FROM grids) GROUP BY 1", grids=_GRIDS.replace("l_linenumber AS pos", "l_linenumber * 1000000 + l_partkey AS pos")))
def d22_merged_grids(spark, sf):
    piece = _GRIDS.replace("l_linenumber AS pos", "l_linenumber * 1000000 + l_partkey AS pos").replace(" FROM", ", _file, _row FROM")
    return A.merged_grids(spark.sql(piece, lineitem=load_in_order(spark, sf, "lineitem")), ["k"], "pos", ["_file", "_row"])


_RESULTS = "SELECT user_id AS task_id, event_type = 'purchase' AS passed FROM {events}"
_TASKS = "SELECT c_custkey AS task_id, c_mktsegment AS level FROM {customer}"


@query(duck("SELECT level, count(*) AS n_tasks, round(avg(CASE WHEN task_id IN (SELECT task_id FROM results WHERE passed) THEN 1.0 ELSE 0.0 END), 4) AS pass_rate FROM tasks GROUP BY 1", tasks=_TASKS, results=_RESULTS))
def d13_rates_by_difficulty(spark, sf):
    return A.rates_by(made(spark, sf, _TASKS), made(spark, sf, _RESULTS), "level")


@query(duck("SELECT task_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM results WHERE passed)", tasks=_TASKS, results=_RESULTS))
def d13_failed_tasks(spark, sf):
    return A.failed_tasks(made(spark, sf, _TASKS), made(spark, sf, _RESULTS))


@query(duck("SELECT task_id, task_id IN (SELECT task_id FROM results WHERE passed) AS covered FROM tasks", tasks=_TASKS, results=_RESULTS))
def d15_coverage_map(spark, sf):
    return A.coverage_map(made(spark, sf, _TASKS), made(spark, sf, _RESULTS).filter("passed"), ["task_id"])


@query("SELECT count(*) AS matched, round(avg(CASE WHEN f.o_orderstatus = t.o_orderpriority THEN 1.0 WHEN (f.o_orderstatus = 'F') = (t.o_orderpriority = '1-URGENT') THEN 1.0 ELSE 0.0 END), 4) AS section_accuracy FROM orders f JOIN orders t ON f.o_orderkey = t.o_orderkey WHERE f.o_totalprice > 1000 AND t.o_totalprice < 400000")
def d24_section_accuracy(spark, sf):
    orders = load(spark, sf, "orders")
    found = orders.filter("o_totalprice > 1000").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "urgent").otherwise("plain").alias("section"))
    truth = orders.filter("o_totalprice < 400000").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("plain").alias("section"))
    return A.section_accuracy(found, truth, ["o_orderkey"], "section")


@query("SELECT p_brand, p_partkey, w FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY w * p_size DESC, p_partkey) AS r FROM (SELECT *, CASE WHEN p_name LIKE '%gear%' THEN 2.0::DOUBLE WHEN p_name LIKE '%rod%' THEN 0.5 ELSE 1.0 END AS w FROM part)) WHERE r = 1")
def d4_weighted_best(spark, sf):
    rows = load(spark, sf, "part").select("p_brand", "p_partkey", A.criticality_level(F.col("p_name"), ("gear",), ("rod",)).alias("w"), "p_size").withColumn("v", F.col("w") * F.col("p_size"))
    return A.arg_max(rows, ["p_brand"], "v", "p_partkey").select("p_brand", "p_partkey", "w")


@query(
    """WITH p AS (SELECT event_type AS kind, user_id AS part, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT *, sum(n) OVER (PARTITION BY kind) AS nk FROM p)
SELECT kind, part, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(m, 9) DESC, part) AS r FROM q WHERE nk >= 3 AND part % 2 = 0) WHERE r <= 2"""
)
def e4_alternatives(spark, sf):
    history = load(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("part"), "value")
    return R.preferred(history, "kind", "part", "value", current=history.filter("part % 2 <> 0")).select("kind", "part", "rank")


_GRID_TEXT = "SELECT l_partkey AS grid_id, l_orderkey % 6 AS row, l_linenumber AS col, CASE l_suppkey % 4 WHEN 0 THEN '' ELSE CAST(l_suppkey % 3 AS STRING) END AS text, l_orderkey AS o FROM {lineitem}"
_ONE_CELL = "cells AS (SELECT grid_id, row, col, arg_min(text, o) AS text FROM grid GROUP BY 1, 2, 3)"
_RUNS = """, s AS (SELECT *, CASE WHEN text = lag(text) OVER w THEN 0 ELSE 1 END AS new FROM cells WINDOW w AS (PARTITION BY grid_id, {by} ORDER BY {at})), r AS (SELECT *, sum(new) OVER (PARTITION BY grid_id, {by} ORDER BY {at}) AS run FROM s)
SELECT grid_id, {by}, min({at}) AS {at}, min(text) AS text, CASE WHEN length(min(text)) > 0 THEN count(*) ELSE 1 END AS {span} FROM r GROUP BY grid_id, {by}, run"""


def _cells(spark, sf):
    return made(spark, sf, _GRID_TEXT.replace("l_orderkey AS o", "l_orderkey * 100 + l_suppkey AS o")).groupBy("grid_id", "row", "col").agg(F.min_by("text", "o").alias("text"))


@query(duck(", " + _ONE_CELL + _RUNS.format(by="row", at="col", span="colspan"), grid=_GRID_TEXT.replace("l_orderkey AS o", "l_orderkey * 100 + l_suppkey AS o")))
def e6_column_spans(spark, sf):
    return R.merged_cells(_cells(spark, sf))


@query(duck(", " + _ONE_CELL + _RUNS.format(by="col", at="row", span="rowspan"), grid=_GRID_TEXT.replace("l_orderkey AS o", "l_orderkey * 100 + l_suppkey AS o")))
def e6_row_spans(spark, sf):
    return R.merged_rows(_cells(spark, sf))


@query(
    """WITH RECURSIVE t AS (SELECT user_id AS doc_id, CAST(event_id AS INTEGER) AS page, CAST(event_id % 2 AS INTEGER) AS n_cols, event_type AS header, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE 'y' END AS event_type FROM events)),
w AS (SELECT doc_id, page, i, false AS same, n_cols AS base_cols, header AS base_header FROM t WHERE i = 1
UNION ALL SELECT t.doc_id, t.page, t.i, c, CASE WHEN c THEN base_cols ELSE t.n_cols END, CASE WHEN c THEN base_header ELSE t.header END
  FROM (SELECT t.*, w.base_cols, w.base_header, t.n_cols = w.base_cols AND t.page = w.page + 1 AND t.header = w.base_header AS c FROM t JOIN w ON t.doc_id = w.doc_id AND t.i = w.i + 1) t)
SELECT doc_id, page, 0 AS pos, same AS is_continuation FROM w"""
)
def e5_continuations(spark, sf):
    tables = made(spark, sf, "SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS page, 0 AS pos, event_id FROM {events}")
    tables = tables.select("doc_id", "page", "pos", (F.col("page") % 2).cast("int").alias("n_cols"), F.array(F.when(F.col("event_id") % 3 == 0, "x").otherwise("y")).alias("header"))
    return R.continuations(tables)


_ENTRIES = "SELECT l_orderkey AS design_id, CAST(l_partkey AS STRING) AS ref, l_linenumber - 1 AS alt_rank, l_quantity / 50 AS confidence FROM {lineitem}"


@query(duck("SELECT design_id, alt_rank, v AS variant_confidence FROM (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY v DESC, alt_rank, ref) AS r FROM (SELECT *, round(confidence * pow(0.97, alt_rank), 4) AS v FROM entries)) WHERE r <= 3", entries=_ENTRIES))
def f8_ladders(spark, sf):
    return R.ladder(made(spark, sf, _ENTRIES), ["design_id"]).select("design_id", "alt_rank", "variant_confidence")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC NULLS LAST, side) AS r FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey, max(o_totalprice) AS o_totalprice, CASE WHEN o_custkey % 5 > 0 THEN max(o_totalprice) END AS s, 0 AS side FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, max(o_orderkey), max(o_totalprice), max(o_totalprice), 1 FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)) WHERE r = 1")
def e13_better_extraction(spark, sf):
    per = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))
    orders = load(spark, sf, "orders")
    a = per(orders.filter("o_orderstatus = 'F'")).withColumn("s", F.when(F.col("o_custkey") % 5 > 0, F.col("o_totalprice")))
    b = per(orders.filter("o_orderstatus <> 'F'")).withColumn("s", F.col("o_totalprice"))
    return R.better_of(a, b, ["o_custkey"], "s").select("o_custkey", "o_orderkey", "o_totalprice")


# Joins

_NOTES = "SELECT o_orderkey AS page, 'intro (' || CAST(o_custkey % 3 AS STRING) || ') cost ' || o_orderpriority || ' (9)  status ' || o_orderstatus || CASE WHEN o_orderkey % 4 = 0 THEN ' (9) again' ELSE '' END AS text FROM {orders}"
_DEFINED = ", d AS (SELECT page, unnest(regexp_extract_all(text, '\\(([0-9]+)\\)', 1)) AS marker, unnest(range(length(text))) AS pos, unnest(regexp_split_to_array(text, '\\([0-9]+\\)')[2:]) AS body FROM notes), defined AS (SELECT page, marker, pos, trim(body) AS body FROM d WHERE marker IS NOT NULL)"


@query(duck(_DEFINED + " SELECT page, marker, CAST(pos AS INTEGER) AS pos, body FROM defined", notes=_NOTES))
def e7_definitions(spark, sf):
    return J.definitions_of(made(spark, sf, _NOTES))


@query(duck(_DEFINED + ", marks AS (SELECT o_orderkey AS page, CAST(o_custkey % 4 AS VARCHAR) AS marker FROM orders UNION ALL SELECT o_orderkey, '9' FROM orders) SELECT page, marker, (SELECT arg_min(body, pos) FROM defined x WHERE x.page = m.page AND x.marker = m.marker) AS body FROM marks m", notes=_NOTES))
def c19_footnotes(spark, sf):
    marks = made(spark, sf, "SELECT o_orderkey AS page, CAST(o_custkey % 4 AS STRING) AS marker FROM {orders} UNION ALL SELECT o_orderkey, '9' FROM {orders}")
    return J.footnotes(marks, J.definitions_of(made(spark, sf, _NOTES)))


_INSTANCES = "SELECT 'i' || CAST(p_partkey AS STRING) AS instance_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE 'other' END AS component_type FROM {part}"
_TYPES = "SELECT DISTINCT p_name AS type_id, p_name AS label FROM {part}"
_RULES = "SELECT p_name AS source_id, 'i' || CAST(p_partkey + p_size AS STRING) AS target_id FROM {part} WHERE p_size > 25"


@query(duck(", a AS (SELECT lower(component_type) AS t, min(instance_id) AS direct FROM instances GROUP BY 1), b AS (SELECT source_id, min(target_id) AS ruled FROM ruled WHERE target_id IN (SELECT instance_id FROM instances) GROUP BY 1) SELECT type_id, coalesce(direct, ruled) AS instance_id, CASE WHEN direct IS NOT NULL THEN 'property' WHEN ruled IS NOT NULL THEN 'rule' END AS via FROM types LEFT JOIN a ON lower(label) = t LEFT JOIN b ON source_id = type_id", instances=_INSTANCES, types=_TYPES, ruled=_RULES))
def c6_resolved_types(spark, sf):
    return J.resolve(made(spark, sf, _INSTANCES), made(spark, sf, _TYPES), made(spark, sf, _RULES)).select("type_id", "instance_id", "via")


_NEEDED = "SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS slug FROM {orders}"
_HAVE = "SELECT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) ELSE 'x' END AS block_slug, 'block:' || CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS STRING) ELSE 'y' END AS block_id FROM {customer}"


@query(duck("SELECT id, slug FROM needed WHERE slug NOT IN (SELECT block_slug FROM have) AND slug NOT IN (SELECT string_split(block_id, ':')[-1] FROM have)", needed=_NEEDED, have=_HAVE))
def c17_open_requirements(spark, sf):
    return J.unresolved_requirements(made(spark, sf, _NEEDED), made(spark, sf, _HAVE))


# Texts

_RAW_PINS = "SELECT DISTINCT l_orderkey % 400 AS component_id, CASE l_partkey % 19 WHEN 0 THEN 'VDD' WHEN 1 THEN 'gpio3' WHEN 2 THEN 'NRST' WHEN 3 THEN 'CLK' WHEN 4 THEN 'SDA' WHEN 5 THEN 'MOSI' WHEN 6 THEN 'TX1' WHEN 7 THEN 'DATA' WHEN 8 THEN 'CS' WHEN 9 THEN '!INT' WHEN 10 THEN 'NEN' ELSE 'P' || CAST(l_partkey % 19 AS STRING) END AS raw_name FROM {lineitem}"
_ALIASES = (("VDD", "POWER_POSITIVE"), ("GPIO", "GPIO"), ("RST", "RESET"), ("TX", "UART_TRANSMIT"))


@query(
    duck(
        """, b AS (SELECT component_id, bool_or(raw_name = 'SDA') AS i2c, bool_or(raw_name = 'MOSI') AS spi, bool_or(raw_name = 'CS') AS cs, bool_or(raw_name = 'TX1') AS tx FROM pins GROUP BY 1)
SELECT component_id, raw_name, CASE raw_name WHEN 'VDD' THEN 'POWER_POSITIVE' WHEN 'gpio3' THEN 'GPIO' WHEN 'NRST' THEN 'RESET' WHEN 'TX1' THEN 'UART_TRANSMIT' WHEN '!INT' THEN 'INTERRUPT' WHEN 'NEN' THEN 'ENABLE_ACTIVE_LOW'
  WHEN 'CLK' THEN CASE WHEN (spi OR cs) AND NOT i2c THEN 'SPI_CLOCK' WHEN i2c AND NOT (spi OR cs) THEN 'I2C_CLOCK' END
  WHEN 'DATA' THEN CASE WHEN (spi OR cs) AND NOT i2c AND NOT tx THEN 'SPI_DATA_IN' WHEN i2c AND NOT (spi OR cs) AND NOT tx THEN 'I2C_DATA' WHEN tx AND NOT (spi OR cs) AND NOT i2c THEN 'UART_RECEIVE' END
  WHEN 'CS' THEN CASE WHEN spi THEN 'SPI_CHIP_SELECT' END END AS canonical FROM pins JOIN b USING (component_id)""",
        pins=_RAW_PINS,
    )
)
def h8_pin_cascade(spark, sf):
    aliases = spark.createDataFrame(_ALIASES, "alias string, function string")
    return T.normalise_pins(made(spark, sf, _RAW_PINS), aliases).select("component_id", "raw_name", "canonical")


@query(duck("SELECT DISTINCT raw_name, CASE raw_name WHEN 'VDD' THEN 'POWER_POSITIVE' WHEN 'gpio3' THEN 'GPIO' WHEN 'NRST' THEN 'RESET' ELSE 'UART_TRANSMIT' END AS function FROM pins WHERE raw_name IN ('VDD', 'gpio3', 'NRST', 'TX1')", pins=_RAW_PINS))
def h6_pin_dictionary(spark, sf):
    return T.alias_of(made(spark, sf, _RAW_PINS), spark.createDataFrame(_ALIASES, "alias string, function string"))


@query(
    duck(
        """, b AS (SELECT component_id, bool_or(raw_name = 'SDA') AS i2c, bool_or(raw_name IN ('MOSI', 'CS')) AS spi FROM pins GROUP BY 1) SELECT component_id, raw_name, CASE raw_name WHEN 'CLK' THEN CASE WHEN spi AND NOT i2c THEN 'SPI_CLOCK' WHEN i2c AND NOT spi THEN 'I2C_CLOCK' END WHEN '!INT' THEN 'INTERRUPT' ELSE 'ENABLE_ACTIVE_LOW' END AS canonical FROM pins JOIN b USING (component_id) WHERE raw_name IN ('CLK', '!INT', 'NEN')""",
        pins=_RAW_PINS,
    )
)
def h7_pin_context(spark, sf):
    found = T.normalise_pins(made(spark, sf, _RAW_PINS), spark.createDataFrame([], "alias string, function string"))
    return found.filter("raw_name IN ('CLK', '!INT', 'NEN')").select("component_id", "raw_name", "canonical")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SPI_DATA_IN' WHEN 1 THEN 'spi' || p_size || '_sck' ELSE 'led' END AS name, CASE p_partkey % 3 WHEN 1 THEN 'SPI' || p_size END AS peripheral FROM part")
def h9_alternate_functions(spark, sf):
    rows = made(spark, sf, "SELECT p_partkey, array(CASE p_partkey % 3 WHEN 0 THEN ' mosi' WHEN 1 THEN 'spi' || CAST(p_size AS STRING) || '_sck' ELSE 'led' END) AS names FROM {part}")
    return rows.select("p_partkey", T.alternate_functions(F.col("names"), {"MOSI": "SPI_DATA_IN"})[0].alias("x")).select("p_partkey", "x.name", "x.peripheral")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'GROUND' WHEN 1 THEN 'BIDIRECTIONAL' WHEN 2 THEN 'CLOCK' END AS role FROM part")
def h10_roles(spark, sf):
    n = F.col("p_partkey") % 4
    return load(spark, sf, "part").select("p_partkey", T.role(F.when(n == 0, "POWER_GROUND").when(n == 1, "GPIO").when(n == 2, "SPI_CLOCK").otherwise("ODD")).alias("role"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'SOT-23-5' WHEN 1 THEN 'SOIC-8' WHEN 2 THEN 'LQFP-64' ELSE p_name END AS name, p_partkey % 4 = 3 AS needs_review FROM part")
def h12_packages(spark, sf):
    n = F.col("p_partkey") % 4
    text = F.when(n == 0, "DRLR (SOT-23-5)").when(n == 1, "8-pin SOIC body").when(n == 2, "in lqfp 64 form").otherwise(F.concat(F.lit(" "), "p_name"))
    return load(spark, sf, "part").select("p_partkey", T.package(text).alias("x")).select("p_partkey", "x.name", "x.needs_review")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ldo:0.75' WHEN 1 THEN 'buck_boost:0.9' WHEN 2 THEN 'buck_converter:0.75,rc_lowpass:0.75' WHEN 3 THEN 'boost_converter:0.6,ldo:0.6' ELSE '' END AS found FROM part")
def h13_topologies(spark, sf):
    n = F.col("p_partkey") % 5
    text = F.when(n == 0, "a 3.3V LDO").when(n == 1, "the buck-boost part").when(n == 2, "Buck Converter, low-pass filter").when(n == 3, "boost then ldo").otherwise("plain")
    found = F.transform(T.topologies(text), lambda t: F.concat_ws(":", t["name"], t["confidence"].cast("string")))
    return load(spark, sf, "part").select("p_partkey", F.array_join(found, ",").alias("found"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'RF_highfreq' WHEN 1 THEN 'power_management' ELSE 'standard_SMD' END AS method, p_partkey % 3 = 0 AS overridden FROM part")
def h14_methods(spark, sf):
    n = F.col("p_partkey") % 3
    text, proposed = F.when(n == 0, "2.4GHz patch antenna").when(n == 1, "a buck for an adc").otherwise("plain board"), F.when(n == 1, "power_management").otherwise("standard_SMD")
    return load(spark, sf, "part").select("p_partkey", T.methodology(text, proposed).alias("x")).select("p_partkey", "x.method", "x.overridden")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ldo_regulator' WHEN 1 THEN 'unknown' WHEN 2 THEN 'low_noise_' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) END AS goal FROM part")
def h15_goals(spark, sf):
    n, name = F.col("p_partkey") % 4, F.split("p_name", " ")
    text = F.when(n == 0, F.concat(F.lit("a_"), F.col("p_size").cast("string"), F.lit("v_ldo"))).when(n == 1, "the").when(n == 2, F.concat(F.lit("Build-a_low-noise_"), name[0])).otherwise(F.concat(name[0], F.lit("_"), name[1], F.lit("_for_the")))
    return load(spark, sf, "part").select("p_partkey", T.clean_goal(text).alias("goal"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a_low_power_' || split_part(p_name, ' ', 2) ELSE 'circuit' END AS goal, CASE p_partkey % 4 WHEN 0 THEN 'RF_highfreq' ELSE 'standard_SMD' END AS method, CASE p_partkey % 4 WHEN 0 THEN 'drone' WHEN 2 THEN 'medical' ELSE 'unspecified' END AS application, CASE WHEN p_partkey % 2 = 0 THEN '4_layer' ELSE 'double_sided_SMD' END AS board, CASE WHEN p_partkey % 2 = 0 THEN 'low_power' ELSE '' END AS constraints FROM part")
def h16_prompts(spark, sf):
    n = F.col("p_partkey") % 4
    end = F.when(n == 0, " with LoRa for a drone").when(n == 2, " for medical use").otherwise("")
    text = F.when(n % 2 == 0, F.concat(F.lit("I will BUILD a low power "), F.split("p_name", " ")[1], end, F.lit(", 4 layer"))).otherwise("x")
    found = load(spark, sf, "part").select("p_partkey", T.parse_design(text).alias("d"))
    return found.select("p_partkey", "d.goal", "d.method", "d.application", "d.board", F.array_join("d.constraints", ",").alias("constraints"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'goal,application,frequency' WHEN 1 THEN 'application' ELSE '' END AS fields, p_partkey % 3 = 0 AS blocking FROM part")
def h17_ambiguities(spark, sf):
    n = F.col("p_partkey") % 3
    found = T.ambiguities(F.when(n == 0, "my_Circuit").otherwise(F.col("p_name")), F.when(n == 2, "drone").otherwise("Unspecified"), F.when(n == 1, "standard_SMD").otherwise("RF_highfreq"), F.when(n == 2, 2.4e9))
    rows = load(spark, sf, "part").select("p_partkey", found.alias("a"))
    return rows.select("p_partkey", F.array_join(F.transform("a", lambda x: x["field"]), ",").alias("fields"), F.exists("a", lambda x: x["blocking"]).alias("blocking"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS words FROM (SELECT p_partkey, list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), CASE WHEN lower(p_type) NOT IN (split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) THEN lower(p_type) END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM part)")
def h18_goal_words(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.array_join(T.goal_words(F.concat_ws("__", "p_name", "p_type", "p_name")), ",").alias("words"))


@query("SELECT id AS p_partkey FROM (SELECT p_partkey AS id, p_name FROM part WHERE p_name = 'small gear' ORDER BY 1 LIMIT 5)")
def h19_goal_nodes(spark, sf):
    nodes = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return G.match_goal(nodes, "small_gear").select(F.col("id").alias("p_partkey"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'Place C' || p_size || ' close to the pin of U1' ELSE '' END AS found FROM part")
def h22_placement_sentences(spark, sf):
    text = F.concat(F.lit("The sky is blue today. "), F.when(F.col("p_partkey") % 3 < 2, F.concat(F.lit("Place C"), F.col("p_size").cast("string"), F.lit(" close to the pin of U1. "))).otherwise(""), F.lit("Done now."))
    return load(spark, sf, "part").select("p_partkey", F.array_join(T.placement_sentences(text), "|").alias("found"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PROPERTY' WHEN 1 THEN 'DESIGN_PATTERN' ELSE 'COMPONENT_TYPE' END AS kind FROM part")
def h24_node_kinds(spark, sf):
    n = F.col("p_partkey") % 3
    label = F.when(n == 0, F.concat(F.lit("gain of "), F.col("p_size").cast("string"), F.lit(" dB"))).when(n == 1, "Buck Converter").otherwise(F.col("p_name"))
    return load(spark, sf, "part").select("p_partkey", N.node_kind(label).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pin' WHEN 1 THEN 'pin' WHEN 2 THEN 'board_edge' ELSE 'component' END AS kind FROM part")
def h26_relative_kinds(spark, sf):
    n, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    return load(spark, sf, "part").select("p_partkey", T.relative_kind(F.when(n == 0, F.concat(F.lit("U1."), size)).when(n == 1, F.concat(F.lit("pin "), size)).when(n == 2, "the Board's edge").otherwise(F.concat(F.lit("C"), size))).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'v' ELSE '' END AS keys FROM part")
def h32_matching_properties(spark, sf):
    size = F.col("p_size").cast("string")
    held = F.create_map(F.lit("v"), F.concat(size, F.lit(".5 V")), F.lit("t"), F.lit(""))
    asked = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("part of "), size, F.lit(".5v rating"))).otherwise("none")
    return load(spark, sf, "part").select("p_partkey", F.array_join(T.matching_properties(held, asked), ",").alias("keys"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 5 THEN p_name END, 'Unresolved part') || ' serves as ' || lower(p_type) || ' part (confidence ' || printf('%.2f', CAST(p_size % 10 AS DOUBLE) / 10) || ')' AS text FROM part")
def h34_justifications(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.justification(F.when(F.col("p_size") > 5, F.col("p_name")), F.concat(F.lower("p_type"), F.lit("_part")), (F.col("p_size") % 10).cast("double") / 10).alias("text"))


@query("SELECT p_partkey, 'TPS' || (1000 + p_partkey) AS part, CASE WHEN p_size % 2 = 0 THEN 'SOIC-8' END AS package, CASE WHEN p_size % 3 = 0 THEN p_size || 'V to 90.5 V' END AS supply FROM part")
def h35_headers(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.concat_ws(" ", F.concat(F.lit("TPS"), (F.col("p_partkey") + 1000).cast("string")), F.when(F.col("p_size") % 2 == 0, "in SOIC-8"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("for "), size, F.lit("V to 90.5 V"))))
    return load(spark, sf, "part").select("p_partkey", N.header_fields(text).alias("h")).select("p_partkey", "h.part", "h.package", "h.supply")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 2 END AS layers, CASE WHEN p_size % 2 = 0 THEN 'Rogers_4003C' ELSE 'FR4' END AS material FROM part")
def h41_boards(spark, sf):
    designs = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "RF_highfreq").otherwise(F.col("p_type")).alias("methodology"))
    return N.board_of(designs, spark).select("p_partkey", "layers", "material")


@query("SELECT p_partkey, lower(p_type) || ' part ' || 'gain ' || p_size || ' noise max low' AS text FROM part")
def h2_query_text(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", T.query_text(F.concat(F.lower("p_type"), F.lit("_part")), F.create_map(F.lit("noise_max"), F.lit("low"), F.lit("gain"), F.col("p_size").cast("string"))).alias("text"))
    return rows


@query("SELECT p_partkey, 'component:' || replace(p_name, ' ', '_') || '_' || p_size AS id FROM part")
def h25_graph_slugs(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.graph_slug(F.concat(F.lit(" "), F.initcap("p_name"), F.lit("!  -"), F.col("p_size").cast("string")), "component").alias("id"))


_EMBEDDED = "SELECT l_partkey, collect_list(struct(CAST(l_orderkey AS STRING) AS name, CAST(l_linenumber AS STRING) AS value)) AS parameters FROM {lineitem} GROUP BY 1"


@query("SELECT p_partkey, p_name || '. ' || p_type || '. ' || (SELECT string_agg(n || ': ' || v, '; ' ORDER BY n, v) FROM (SELECT CAST(l_orderkey AS VARCHAR) AS n, CAST(l_linenumber AS VARCHAR) AS v, row_number() OVER (ORDER BY CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS r FROM lineitem WHERE l_partkey = p_partkey) WHERE r <= 10) AS text FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def f9_embedding_texts(spark, sf):
    rows = load(spark, sf, "part").join(made(spark, sf, _EMBEDDED), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("p_partkey", T.embedding_text(F.col("p_name"), F.col("p_type"), F.col("parameters")).alias("text"))


# Graph

_NODES = """SELECT 'topology:' || p_brand AS id, 'TOPOLOGY' AS node_type, p_brand AS label, 1 AS layer, 1.0 AS confidence, CAST(NULL AS BIGINT) AS size FROM (SELECT DISTINCT p_brand FROM {part})
UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN 'COMPONENT_TYPE' WHEN 1 THEN 'FUNCTIONAL_BLOCK' WHEN 2 THEN 'DESIGN_RECIPE' ELSE 'PROPERTY' END, p_name, 2 + CAST(p_partkey % 3 AS INT), p_size / 50.0, CASE WHEN p_size > 20 THEN CAST(p_size AS BIGINT) END FROM {part}"""
_LINKS = """SELECT 'part:' || CAST(p_partkey AS STRING) AS source_id, 'PART_OF' AS relation, 'topology:' || p_brand AS target_id, 0.9 AS confidence FROM {part}
UNION ALL SELECT 'topology:' || p_brand, 'USES', 'part:' || CAST(p_partkey AS STRING), 0.5 + p_size / 100.0 FROM {part} WHERE p_size % 3 = 0
UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), 'REQUIRES', 'part:' || CAST(p_partkey + 1 AS STRING), 0.55 + (p_size % 10) / 20.0 FROM {part} WHERE p_partkey % 2 = 0"""
_GOAL = "Brand#13"


@query(duck("SELECT id FROM nodes WHERE node_type = 'COMPONENT_TYPE' AND layer = 3 AND size IS NOT NULL", nodes=_NODES))
def b8_select_nodes(spark, sf):
    return G.select_nodes(made(spark, sf, _NODES), "COMPONENT_TYPE", 3, having="size").select("id")


@query(duck("SELECT id FROM nodes WHERE id IN ('part:1', 'part:2', 'part:99999999')", nodes=_NODES))
def b8_nodes_by_id(spark, sf):
    return G.select_nodes(made(spark, sf, _NODES), ids=["part:1", "part:2", "part:99999999"]).select("id")


@query(duck("SELECT id FROM nodes WHERE node_type IN ('COMPONENT_TYPE', 'COMPONENT_INSTANCE', 'DESIGN_RECIPE')", nodes=_NODES))
def b16_searchable(spark, sf):
    return V.searchable(made(spark, sf, _NODES)).select("id")


@query(duck("SELECT layer, n FROM (SELECT CAST(k AS INTEGER) AS layer, count(id) AS n FROM range(1, 6) r(k) LEFT JOIN nodes ON layer = k GROUP BY 1)", nodes=_NODES))
def d6_layer_stats(spark, sf):
    return G.layer_stats(made(spark, sf, _NODES))


_STARTED = f", t AS (SELECT id FROM nodes WHERE string_split(id, ':')[-1] = '{_GOAL}'), start AS (SELECT id FROM t UNION SELECT source_id FROM links WHERE relation = 'PART_OF' AND target_id IN (SELECT id FROM t))"


@query(duck(_STARTED + " SELECT id FROM start", nodes=_NODES, links=_LINKS))
def i4_start_nodes(spark, sf):
    return G.start_nodes(made(spark, sf, _NODES), made(spark, sf, _LINKS), spark.createDataFrame([(_GOAL,)], "slug string"))


@query(duck(" SELECT id FROM nodes WHERE string_split(id, ':')[-1] IN ('7', '8') AND node_type <> 'TOPOLOGY'", nodes=_NODES))
def g2_starts_of_several_goals(spark, sf):
    goals = spark.createDataFrame([("7",), ("8",), ("7",)], "slug string")
    return G.start_nodes(made(spark, sf, _NODES), made(spark, sf, _LINKS), goals)


_REACHED = _STARTED + """, good AS (SELECT * FROM links WHERE confidence >= 0.6), l0 AS (SELECT id, 0 AS depth, 1.0 AS p FROM start),
s1 AS (SELECT source_id, target_id, relation, g.confidence AS c, p * g.confidence AS q, row_number() OVER (PARTITION BY target_id ORDER BY p * g.confidence DESC, source_id) AS r FROM good g JOIN l0 ON source_id = id WHERE target_id NOT IN (SELECT id FROM l0)), l1 AS (SELECT target_id AS id, 1 AS depth, q AS p FROM s1 WHERE r = 1),
s2 AS (SELECT source_id, target_id, relation, g.confidence AS c, p * g.confidence AS q, row_number() OVER (PARTITION BY target_id ORDER BY p * g.confidence DESC, source_id) AS r FROM good g JOIN l1 ON source_id = id WHERE target_id NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1)), l2 AS (SELECT target_id AS id, 2 AS depth, q AS p FROM s2 WHERE r = 1),
v AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


@query(duck(_REACHED + " SELECT id, depth, round(p, 6) AS path_confidence, CASE node_type WHEN 'COMPONENT_TYPE' THEN 'components' WHEN 'TOPOLOGY' THEN 'topologies' WHEN 'FUNCTIONAL_BLOCK' THEN 'blocks' ELSE 'other' END AS category FROM v JOIN nodes USING (id) WHERE node_type <> 'PROPERTY'", nodes=_NODES, links=_LINKS))
def i7_query_graph(spark, sf):
    goals = spark.createDataFrame([(_GOAL,)], "slug string")
    found = G.query_graph(made(spark, sf, _NODES), made(spark, sf, _LINKS), goals, suppressed=["PROPERTY"], depth=2)[0]
    return found.select("id", "depth", F.round("path_confidence", 6).alias("path_confidence"), "category")


@query(duck(_REACHED + " SELECT source_id, target_id, relation FROM s1 WHERE r = 1 AND relation = 'REQUIRES' UNION ALL SELECT source_id, target_id, relation FROM s2 WHERE r = 1 AND relation = 'REQUIRES'", nodes=_NODES, links=_LINKS))
def i6_design_rules(spark, sf):
    goals = spark.createDataFrame([(_GOAL,)], "slug string")
    rule = F.when(F.col("relation") == "REQUIRES", F.create_map(F.lit("gap"), F.lit("1 mm"))).otherwise(F.create_map().cast("map<string,string>"))
    edges = made(spark, sf, _LINKS).withColumn("constraints", rule)
    return G.query_graph(made(spark, sf, _NODES), edges, goals, depth=2)[1].select("source_id", "target_id", "relation")


_CHANGES = "SELECT 'part:' || CAST(l_partkey AS STRING) AS source_id, l_returnflag AS relation, 'part:' || CAST(l_suppkey AS STRING) AS target_id, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS v FROM {lineitem}"
_OLD = "SELECT 'part:' || CAST(p_partkey AS STRING) AS source_id, 'OLD' AS relation, 'part:' || CAST(p_partkey % 7 AS STRING) AS target_id, 0.5 AS confidence, CAST(0 AS BIGINT) AS v FROM {part}"
_ENDS = "SELECT 'part:' || CAST(p_partkey AS STRING) AS id FROM {part} WHERE p_partkey % 5 > 0"


@query(duck(", ok AS (SELECT * FROM changes WHERE source_id IN (SELECT id FROM ends) AND target_id IN (SELECT id FROM ends)), u AS (SELECT * FROM old UNION ALL SELECT * FROM ok) SELECT source_id, target_id, arg_max(relation, v) AS relation FROM u GROUP BY 1, 2", changes=_CHANGES.replace("l_orderkey * 10 + l_linenumber AS v", "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS v"), old=_OLD, ends=_ENDS))
def i2_edge_upsert(spark, sf):
    changes = made(spark, sf, _CHANGES.replace("l_orderkey * 10 + l_linenumber AS v", "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS v"))
    return G.upsert_edges(made(spark, sf, _OLD), changes, made(spark, sf, _ENDS), "v")[0].select("source_id", "target_id", "relation")


@query(duck("SELECT source_id, target_id, v FROM changes WHERE source_id NOT IN (SELECT id FROM ends) OR target_id NOT IN (SELECT id FROM ends)", changes=_CHANGES, ends=_ENDS))
def i2_refused_edges(spark, sf):
    changes = made(spark, sf, _CHANGES)
    return G.upsert_edges(made(spark, sf, _OLD), changes, made(spark, sf, _ENDS), "v")[1].select("source_id", "target_id", "v")


_SHEET = "SELECT CAST(o_custkey AS STRING) AS component_id, collect_list(struct(CAST(o_orderkey AS STRING) AS number, o_orderstatus AS function)) AS pins, collect_list(struct(CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS symbol, o_totalprice AS value, o_orderpriority AS section)) AS parameters FROM {orders} GROUP BY 1"


@query("SELECT 'component:' || o_custkey AS id, 'COMPONENT_INSTANCE' AS node_type FROM orders GROUP BY o_custkey UNION ALL SELECT 'pin:' || o_custkey || ':' || o_orderkey, 'PIN' FROM orders UNION ALL SELECT DISTINCT 'property:' || o_custkey || ':' || CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus ELSE 'unknown' END || ':' || o_orderpriority, 'PROPERTY' FROM orders")
def i8_datasheet_nodes(spark, sf):
    sheets = made(spark, sf, _SHEET).withColumns({"part": F.concat(F.lit("P"), "component_id"), "confidence": F.lit(0.9)})
    return G.datasheet_graph(sheets)[0].select("id", "node_type")


_PLACING = "SELECT CASE c_custkey % 6 WHEN 0 THEN ' ' ELSE 'Cap ' || CAST(c_custkey % 20 AS STRING) END AS subject, c_mktsegment AS target, CASE WHEN c_nationkey % 2 = 0 THEN 'near' ELSE 'away' END AS kind, c_acctbal / 8000 AS confidence FROM {customer}"


@query(duck(", good AS (SELECT * FROM placed WHERE trim(subject) <> '' AND confidence >= 0.65) SELECT DISTINCT 'PLACEMENT_RULE' AS node_type, subject || ' ' || kind || ' ' || target AS label FROM good UNION ALL SELECT 'COMPONENT_TYPE', min(subject) FROM good WHERE lower(replace(subject, ' ', '_')) <> 'cap_3' GROUP BY lower(replace(subject, ' ', '_'))", placed=_PLACING))
def i9_placement_nodes(spark, sf):
    return N.placement_graph(made(spark, sf, _PLACING), spark.createDataFrame([("cap_3",)], "id string"))[0].select("node_type", "label")


_BLOCK_ROWS = ", ".join(f"('{t}', '{b}', {i})" for t, b, _, names in Y.BLOCKS for i in range(len(names)))
_LAW_ROWS = ", ".join(f"('{t}', '{p}', '{a}', {sign}, {repr(c) if c else 'NULL'})" for t, _, p, a, sign, c in Y.LAWS)
_BUILT = "SELECT 'd' || CAST(o_orderkey AS STRING) AS design_id, CASE WHEN o_custkey % 2 = 0 THEN 'ldo' ELSE 'buck_converter' END AS topology FROM {orders}"


@query(duck(f"SELECT design_id, 'topology:' || topology AS topology, count(DISTINCT b) AS n_blocks, count(*) AS n_inputs FROM built JOIN (VALUES {_BLOCK_ROWS}) v(topology, b, i) USING (topology) GROUP BY ALL", built=_BUILT))
def i10_topology_blocks(spark, sf):
    """The library's blocks for every design, and how many quantities they depend on."""
    parts = made(spark, sf, _BUILT).join(F.broadcast(Y.blocks(spark)), "topology")
    return parts.groupBy("design_id", "topology").agg(F.count("*").alias("n_blocks"), F.sum(F.size("depends_on")).alias("n_inputs")).withColumn("topology", F.concat(F.lit("topology:"), "topology"))


#: A change of a parameter for each line item; laws of the library and, between what they affect and further quantities, a chain with a cycle from the suppliers.
_SHIFTED = """SELECT DISTINCT 'd' || CAST(l_orderkey % 500 AS STRING) AS design_id, CASE WHEN l_orderkey % 2 = 0 THEN 'ldo' ELSE 'buck_converter' END AS topology,
CASE l_partkey % 6 WHEN 0 THEN 'switching_frequency_hz' WHEN 1 THEN 'divider_impedance_ohm' WHEN 2 THEN 'esr_ohm' WHEN 3 THEN 'output_current_a' WHEN 4 THEN 'output_cap_esr_ohm' ELSE 'x' || CAST(l_suppkey % 30 AS STRING) END AS quantity,
CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS sign, CASE WHEN l_orderkey % 3 = 0 THEN 'voltage-mode control' WHEN l_orderkey % 3 = 1 THEN 'ESR-zero-compensated LDO' END AS holds FROM {lineitem} WHERE l_quantity > 45"""
_CHAINED = "SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'ldo' ELSE 'buck_converter' END AS topology, CASE s_suppkey % 4 WHEN 0 THEN 'switching_loss_w' WHEN 1 THEN 'power_dissipation_w' ELSE 'x' || CAST(s_suppkey % 30 AS STRING) END AS parameter, 'x' || CAST((s_suppkey * 7 + 3) % 30 AS STRING) AS affects, CASE WHEN s_suppkey % 9 = 0 THEN -1 ELSE 1 END AS sign FROM {supplier}"


@query(
    duck(
        f""", conditions AS (SELECT DISTINCT design_id, holds FROM changes), laws AS (SELECT * FROM (VALUES {_LAW_ROWS}) v(topology, parameter, affects, sign, condition) UNION ALL SELECT *, NULL FROM chained),
known(design_id, topology, quantity, sign) AS (SELECT design_id, topology, quantity, sign FROM changes
  UNION SELECT k.design_id, k.topology, affects, CAST(k.sign * l.sign AS INTEGER) FROM known k JOIN laws l ON l.topology = k.topology AND l.parameter = k.quantity LEFT JOIN conditions c ON c.design_id = k.design_id AND c.holds = l.condition WHERE l.condition IS NULL OR c.holds IS NOT NULL)
SELECT design_id, quantity, CASE WHEN count(DISTINCT sign) > 1 THEN 'both' WHEN max(sign) = 1 THEN 'up' ELSE 'down' END AS direction FROM known GROUP BY design_id, topology, quantity""",
        changes=_SHIFTED, chained=_CHAINED,
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def i10_scaling_laws(spark, sf):
    changes = made(spark, sf, _SHIFTED).withColumn("conditions", F.array_compact(F.array("holds")))
    own = made(spark, sf, _CHAINED).withColumn("condition", F.lit(None).cast("string"))
    return Y.influences(changes, Y.laws(spark).drop("block").unionByName(own)).select("design_id", "quantity", "direction")


_METHOD_ROWS = ", ".join(f"('{m}', {n}, '{material}', {mm})" for m, n, material, mm in N.METHODS)


@query(f"WITH d AS (SELECT c_custkey, (['{"', '".join(m for m, *_ in N.METHODS)}', 'unheard_of'])[CAST(c_custkey % 6 + 1 AS BIGINT)] AS methodology FROM customer), m AS (SELECT * FROM (VALUES {_METHOD_ROWS}) v(methodology, layers, material, clearance_mm)) SELECT c_custkey, CAST(layers AS INTEGER) AS layers, material, CAST(clearance_mm AS DOUBLE) AS clearance_mm FROM d JOIN m ON m.methodology = CASE WHEN d.methodology IN (SELECT methodology FROM m) THEN d.methodology ELSE 'standard_SMD' END")
def i11_methods(spark, sf):
    """Board, material and clearance of every design by its method."""
    names = F.array(*(F.lit(m) for m, *_ in N.METHODS), F.lit("unheard_of"))
    designs = load(spark, sf, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int")).alias("methodology"))
    return N.board_of(designs, spark).select("c_custkey", "layers", "material", "clearance_mm")


@query("SELECT DISTINCT 'metric:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id FROM lineitem")
def i12_derived_edges(spark, sf):
    metrics = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("inputs")).select(F.concat(F.lit("metric:"), F.col("l_orderkey").cast("string")).alias("metric_id"), "inputs", F.lit(1.0).alias("confidence"))
    return G.derived_edges(metrics).select("source_id", "target_id")


def _constraints(spark, sf):
    intents = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("design_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("scope"), F.struct(F.col("c_nationkey").alias("vin"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") + 1).alias("vout")).alias("electrical"), F.when(F.col("c_custkey") % 4 == 0, F.struct(F.col("c_custkey").alias("t"))).alias("thermal"))
    return N.constraint_nodes(intents, {"electrical": "electrical", "thermal": "thermal"})


@query("SELECT 'constraint:' || c_custkey || ':electrical:' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'global' END AS id, 'vin=' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ',vout=' || (c_nationkey + 1) ELSE '' END AS properties FROM customer UNION ALL SELECT 'constraint:' || c_custkey || ':thermal:' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'global' END, 't=' || c_custkey FROM customer WHERE c_custkey % 4 = 0")
def i14_constraint_nodes(spark, sf):
    return _constraints(spark, sf).select("id", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("properties"))


@query("SELECT 'constraint:' || c_custkey || ':thermal:' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'global' END AS id FROM customer WHERE c_custkey = 8")
def b10_scoped_records(spark, sf):
    return N.scoped_records(_constraints(spark, sf), "8", "thermal").select("id")


@query("SELECT c_custkey AS design_id, count(*) AS n FROM (SELECT c_custkey, c_nationkey AS v FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END FROM customer) WHERE v IS NOT NULL GROUP BY 1")
def h33_flattened_specs(spark, sf):
    rows = _constraints(spark, sf).filter("kind = 'electrical'").select(F.col("design_id").cast("long").alias("design_id"), F.explode("properties").alias("k", "v"))
    return rows.groupBy("design_id").agg(F.count("*").alias("n"))


# Patterns of a netlist

_SPARSE = "SELECT DISTINCT 'd' || CAST(CAST(floor(l_orderkey / 3) AS BIGINT) AS STRING) AS design_id, 'N' || CAST(l_orderkey AS STRING) AS net_name, CASE l_orderkey % 3 WHEN 0 THEN 'power' WHEN 1 THEN 'signal' ELSE 'ground' END AS net_type, 'U' || CAST(l_partkey % 18 AS STRING) AS ref FROM {lineitem}"
_SPARSE_BOM = "SELECT DISTINCT 'd' || CAST(CAST(floor(l_orderkey / 3) AS BIGINT) AS STRING) AS design_id, 'U' || CAST(l_partkey % 18 AS STRING) AS ref, CASE l_partkey % 6 WHEN 0 THEN 'LDO' WHEN 1 THEN 'resistor' WHEN 2 THEN 'capacitor' WHEN 3 THEN 'op_amp' WHEN 4 THEN 'buck' ELSE 'plain' END AS component_type FROM {lineitem}"
_LINKED = """, e AS (SELECT a.design_id, a.ref AS x, b.ref AS y, bool_or(a.net_type = 'power') AS p, bool_or(a.net_type <> 'signal') AS g FROM nets a JOIN nets b ON a.design_id = b.design_id AND a.net_name = b.net_name AND a.ref <> b.ref GROUP BY ALL), t AS (SELECT design_id, ref, lower(component_type) AS kind FROM bom),
size AS (SELECT design_id, count(DISTINCT ref) AS n FROM nets GROUP BY 1), link AS (SELECT design_id, x, y FROM e),
rc AS (SELECT DISTINCT r.design_id FROM t r JOIN e a ON a.design_id = r.design_id AND a.x = r.ref JOIN t c ON c.design_id = r.design_id AND c.ref = a.y AND c.kind LIKE '%capacitor%' JOIN e b ON b.design_id = r.design_id AND b.x = c.ref AND b.y <> r.ref AND b.g JOIN e s ON s.design_id = r.design_id AND s.x = r.ref AND s.y NOT IN (c.ref, b.y)
  WHERE r.kind LIKE '%resistor%' AND (r.design_id, s.y, c.ref) NOT IN (SELECT * FROM link) AND (r.design_id, s.y, b.y) NOT IN (SELECT * FROM link) AND (r.design_id, r.ref, b.y) NOT IN (SELECT * FROM link)),
cs AS (SELECT DISTINCT m.design_id FROM t m JOIN e a ON a.design_id = m.design_id AND a.x = m.ref JOIN t r ON r.design_id = m.design_id AND r.ref = a.y AND r.kind LIKE '%resistor%' JOIN e v ON v.design_id = m.design_id AND v.x = m.ref AND v.p AND v.y <> r.ref JOIN e b ON b.design_id = m.design_id AND b.x = r.ref AND b.g AND b.y NOT IN (m.ref, v.y)
  WHERE m.kind LIKE '%op_amp%' AND (m.design_id, r.ref, v.y) NOT IN (SELECT * FROM link) AND (m.design_id, m.ref, b.y) NOT IN (SELECT * FROM link) AND (m.design_id, v.y, b.y) NOT IN (SELECT * FROM link)),
due AS (SELECT DISTINCT design_id, 'rc_lowpass' AS name FROM t WHERE kind LIKE '%resistor%' UNION ALL SELECT DISTINCT design_id, 'current_source' FROM t WHERE kind LIKE '%op_amp%'),
found AS (SELECT design_id, 'rc_lowpass' AS name FROM rc UNION ALL SELECT design_id, 'current_source' FROM cs)"""


@query(duck(_LINKED + " SELECT design_id, CASE WHEN n < 4 THEN 'topology_too_small' ELSE 'topology_missing' END AS rule, name AS subject FROM due JOIN size USING (design_id) WHERE n < 4 OR (design_id, name) NOT IN (SELECT design_id, name FROM found)", nets=_SPARSE, bom=_SPARSE_BOM))
def k13_topology_checks(spark, sf):
    return K.topology_checks(made(spark, sf, _SPARSE), made(spark, sf, _SPARSE_BOM), ("rc_lowpass", "current_source"))[0].select("design_id", "rule", "subject")


@query(duck(_LINKED + " SELECT design_id FROM found WHERE name = 'rc_lowpass'", nets=_SPARSE, bom=_SPARSE_BOM))
def c23_template_match(spark, sf):
    return K.patterns_in(made(spark, sf, _SPARSE), made(spark, sf, _SPARSE_BOM), ("rc_lowpass",)).filter(F.array_contains("found", "rc_lowpass")).select("design_id")


# Retrieval and plans

_ASKED = "SELECT c_custkey AS design_id, CAST(n AS INT) AS pos, CASE (c_custkey + n) % 5 WHEN 0 THEN 'low_noise_ldo' WHEN 1 THEN 'precision_resistor_pair' WHEN 2 THEN 'pcb_layout_constraint' WHEN 3 THEN NULL ELSE 'relay' END AS implication, CASE (c_custkey * n) % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'odd' END AS priority, c_name AS requirement FROM {customer} JOIN (SELECT r_regionkey AS n FROM {region}) ON true"


@query(duck("SELECT design_id, CASE implication WHEN 'precision_resistor_pair' THEN 'precision_resistor' ELSE implication END AS component_type, CASE implication WHEN 'low_noise_ldo' THEN 2 WHEN 'precision_resistor_pair' THEN 2 ELSE 0 END AS n_required, CAST(row_number() OVER (PARTITION BY design_id ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'LOW' THEN 3 ELSE 99 END, pos) AS INTEGER) AS position FROM asked WHERE implication IS NOT NULL AND implication <> 'pcb_layout_constraint'", asked=_ASKED))
def j1_component_plan(spark, sf):
    return V.plan_components(made(spark, sf, _ASKED)).select("design_id", "component_type", F.size("required").alias("n_required"), "position")


@query("SELECT c_custkey AS design_id, replace(lower(c_mktsegment), '_', ' ') || s AS search_term FROM customer, (VALUES (' circuit design'), (' application note')) v(s) WHERE c_acctbal / 10000 >= 0.6")
def b11_document_plan(spark, sf):
    topologies = load(spark, sf, "customer").select(F.col("c_custkey").alias("design_id"), F.lower("c_mktsegment").alias("name"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return V.plan_documents(topologies).select("design_id", "search_term")


@query("SELECT doc_id, relevance FROM (SELECT doc_id, arg_min(n_chars, source) AS relevance FROM documents GROUP BY 1) ORDER BY relevance DESC, doc_id LIMIT 10")
def f4_ranked_documents(spark, sf):
    found = load(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("relevance"), F.col("source").alias("query_pos"))
    return V.rank_documents(found, "doc_id")


@query("SELECT p_type, p_partkey, CAST(r AS INTEGER) AS kind_rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY round(CAST(p_size AS DOUBLE), 12) DESC, p_partkey) AS r FROM part) WHERE r <= 5")
def f3_top_five_by_type(spark, sf):
    rows = load(spark, sf, "part").select("p_type", "p_partkey", F.col("p_size").cast("double").alias("final_score"))
    return V.top_by_kind(rows, "p_type", "p_partkey").select("p_type", "p_partkey", "kind_rank")


_SEEN = "SELECT o_orderkey AS url, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS etag, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS content_length, o_orderpriority AS head_hash FROM {orders} WHERE o_orderkey % 5 > 0"
_NOW = "SELECT o_orderkey AS url, CASE WHEN o_orderkey % 2 > 0 THEN 'F' END AS etag, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey + o_orderkey % 2 END AS content_length, '1-URGENT' AS head_hash FROM {orders}"


@query(duck("SELECT n.url, coalesce(n.etag <> s.etag, n.content_length <> s.content_length, n.head_hash <> s.head_hash, true) AS changed FROM now n LEFT JOIN seen s USING (url)", seen=_SEEN, now=_NOW))
def j9_freshness(spark, sf):
    return L.freshness(made(spark, sf, _NOW), made(spark, sf, _SEEN), "url").select("url", "changed")


@query(duck("SELECT b.design_id, b.ref, CASE WHEN p_partkey % 3 = 0 THEN 'gen' WHEN b.part IN ('P1', 'P2') THEN 'fix' WHEN component_type IN ('connector', 'op_amp') THEN component_type ELSE 'Device:IC' END AS symbol FROM bom b LEFT JOIN (SELECT DISTINCT 'P' || (p_partkey % 9) AS part, p_partkey % 9 AS p_partkey FROM part) USING (part)", bom=BOM))
def c26_symbols(spark, sf):
    generated = made(spark, sf, "SELECT DISTINCT 'P' || CAST(p_partkey % 9 AS STRING) AS part, 'gen' AS symbol FROM {part} WHERE p_partkey % 9 % 3 = 0")
    fixed = spark.createDataFrame([("P1", "fix"), ("P2", "fix"), ("P3", "lost")], "part string, symbol string")
    by_type = spark.createDataFrame([("connector", "connector"), ("op_amp", "op_amp"), ("op_amp", "z")], "component_type string, symbol string")
    return N.resolve_symbols(made(spark, sf, BOM), generated, fixed, by_type).select("design_id", "ref", "symbol")


@query(duck("SELECT design_id, ref, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM (SELECT design_id, ref, flag FROM flags UNION ALL SELECT design_id, ref, 'unresolved' FROM bom WHERE part IS NULL) WHERE (design_id, ref) IN (SELECT design_id, ref FROM bom) GROUP BY 1, 2", bom=BOM, flags=_FLAGS))
def c25_flags_united(spark, sf):
    bom = made(spark, sf, BOM)
    flags = made(spark, sf, _FLAGS).unionByName(bom.filter("part IS NULL").select("design_id", "ref", F.lit("unresolved").alias("flag")))
    return S.assemble(bom, made(spark, sf, _SHEETS), flags).filter(F.size("flags") > 0).select("design_id", "ref", F.array_join("flags", ",").alias("flags"))


@query(duck("SELECT design_id, ref, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM flags WHERE (design_id, ref) IN (SELECT design_id, ref FROM bom) GROUP BY 1, 2", bom=BOM, flags=_FLAGS))
def g4_flag_sets(spark, sf):
    return S.assemble(made(spark, sf, BOM), made(spark, sf, _SHEETS), made(spark, sf, _FLAGS)).filter(F.size("flags") > 0).select("design_id", "ref", F.array_join("flags", ",").alias("flags"))


@query("SELECT o_orderkey, p_partkey, same_kind FROM (SELECT o_orderkey, p_partkey, same AS same_kind, row_number() OVER (PARTITION BY o_orderkey ORDER BY NOT same, p_partkey) AS r FROM (SELECT o_orderkey, p_partkey, o_custkey % 4 = p_size % 4 AS same FROM orders JOIN part ON o_totalprice BETWEEN p_retailprice * 100 AND p_retailprice * 100 + 900)) WHERE r = 1")
def c22_best_range(spark, sf):
    points = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 4).cast("int").alias("kind"))
    ranges = load(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 900).alias("high"), (F.col("p_size") % 4).alias("kind"))
    return J.best_range(points, ranges, "o_orderkey", "o_totalprice", "low", "high", "kind", "p_partkey", 500.0).select("o_orderkey", "p_partkey", "same_kind")


@query("SELECT user_id AS design_id, event_type AS kind, CAST(event_id % 9 AS VARCHAR) AS net, min(event_id) AS pos FROM events GROUP BY 1, 2, 3")
def g9_distinct_moves(spark, sf):
    from fathomgrid.operators.search import distinct_moves

    moves = load(spark, sf, "events").select(F.col("user_id").alias("design_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 9).cast("string").alias("net"), F.lit("U1").alias("ref"), F.lit("1").alias("pin"), F.col("event_id").alias("pos"))
    return distinct_moves(moves).select("design_id", "kind", "net", "pos")


@query("SELECT p_partkey, part, CAST(alt AS INTEGER) AS alt_rank, round(p_size / 50.0 * pow(0.97, alt), 4) AS variant_confidence FROM (SELECT p_partkey, p_size, 'own' AS part, 0 AS alt FROM part UNION ALL SELECT p_partkey, p_size, b, k FROM part, (VALUES ('best', 1), ('own', 2), ('last', 3), ('none', 4)) v(b, k) WHERE p_type = 'PROMO' AND b <> 'own') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY round(p_size / 50.0 * pow(0.97, alt), 4) DESC, alt) <= 3")
def l3_enriched_ladders(spark, sf):
    entries = load(spark, sf, "part").select("p_partkey", F.col("p_type").alias("kind"), F.lit("own").alias("part"), (F.col("p_size") / 50.0).cast("double").alias("confidence"))
    best = spark.createDataFrame([("PROMO", "best", 1), ("PROMO", "own", 2), ("PROMO", "last", 3), ("PROMO", "none", 4)], "kind string, part string, rank int")
    return R.enriched_ladder(entries, best, ["p_partkey"], "kind").select("p_partkey", "part", "alt_rank", "variant_confidence")


# Sources, sinks and the review log


@query("SELECT page_id, url FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 3) ORDER BY page_id LIMIT 1")
def a4_document_lookup(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", "url")
    wanted = pages.filter("page_id = 3").first().url
    return L.lookup(pages, "url", wanted, order="page_id").select("page_id", "url")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events WHERE event_id % 4 > 0 GROUP BY 1")
def a12_json_records(spark, sf):
    from fathomgrid.sources.readers import blobs

    rows = load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("props")).otherwise("{broken").alias("blob"))
    return blobs(rows, "blob", "k INT")[0].groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS source, 'power' AS term, CAST(0 AS INTEGER) AS pos, p_name AS alias FROM part UNION ALL SELECT p_partkey, 'power', 1, lower(p_type) FROM part UNION ALL SELECT p_partkey, 'clock', 0, 'clk' FROM part UNION ALL SELECT p_partkey, 'clock', 1, 'x' || p_size FROM part")
def a13_vocabulary(spark, sf):
    from fathomgrid.sources.readers import vocabulary

    body = F.concat(F.lit("# words\npower:  # supplies\n  - \""), "p_name", F.lit("\"\n  - "), F.lower("p_type"), F.lit("\nclock: [clk, 'x"), F.col("p_size").cast("string"), F.lit("']\nempty:\n"))
    return vocabulary(load(spark, sf, "part").select("p_partkey", body.alias("body")), "p_partkey", "body")


@query("SELECT 'S' || p_partkey AS symbol, '1' AS pin_number, 'IN' AS pin_name, 'input' AS pin_type FROM part UNION ALL SELECT 'S' || p_partkey, '2', upper(p_type), CASE WHEN p_size % 2 = 0 THEN 'output' ELSE 'passive' END FROM part")
def a15_symbol_pins(spark, sf):
    from fathomgrid.sources.readers import symbol_pins

    n = F.col("p_partkey").cast("string")
    body = F.concat(F.lit('(kicad_symbol_lib (symbol "S'), n, F.lit('" (property "Reference" "U") (symbol "S'), n, F.lit('_1_1" (pin input line (name "IN") (number "1")) (pin '), F.when(F.col("p_size") % 2 == 0, "output").otherwise("passive"), F.lit(' line (name "'), F.upper("p_type"), F.lit('") (number "2")))))'))
    return symbol_pins(load(spark, sf, "part").select(n.alias("path"), body.alias("body")), "path", "body").select("symbol", "pin_number", "pin_name", "pin_type")


@query("SELECT 'F' || p_partkey AS footprint, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 * p_size END AS DOUBLE) AS width, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size + 1 END AS DOUBLE) AS height, p_size % 3 = 0 AS needs_review FROM part")
def a16_footprint_boxes(spark, sf):
    from fathomgrid.sources.readers import footprint_boxes

    size = F.col("p_size").cast("string")
    layer = F.when(F.col("p_size") % 3 == 0, "F.SilkS").otherwise("F.CrtYd")
    body = F.concat(F.lit('(footprint "F'), F.col("p_partkey").cast("string"), F.lit('" (fp_line (start -'), size, F.lit(" -1) (end "), size, F.lit(" "), size, F.lit(') (layer "'), layer, F.lit('")))'))
    return footprint_boxes(load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("body")), "path", "body").select("footprint", "width", "height", "needs_review")


@query("SELECT p_name AS name, arg_max(p_type, p_partkey) AS path FROM part GROUP BY 1")
def a17_library_map(spark, sf):
    from fathomgrid.sources.readers import library_map

    return library_map(load(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_partkey").alias("v")), "name", "v").select("name", "path")


@query("SELECT run_id, phase FROM (SELECT c_custkey AS run_id, phase, max(CASE WHEN NOT done THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY pos) AS gap FROM (SELECT c_custkey, r_name AS phase, r_regionkey AS pos, (c_custkey + r_regionkey) % 3 > 0 AS done FROM customer, region)) WHERE gap = 1")
def a25_phases_to_run(spark, sf):
    phases = made(spark, sf, "SELECT c_custkey AS run_id, r_name AS phase, r_regionkey AS pos FROM {customer} JOIN {region} ON true")
    return N.phases_to_run(phases, phases.filter("(run_id + pos) % 3 > 0")).select("run_id", "phase")


@query(duck("SELECT design_id, '(export' || chr(10) || string_agg(net, chr(10) ORDER BY net) || ')' AS value FROM (SELECT design_id, '  (net (name \"' || net_name || '\")' || chr(10) || string_agg('    (node (ref ' || ref || ') (pin ' || pin_number || '))', chr(10) ORDER BY '    (node (ref ' || ref || ') (pin ' || pin_number || '))') || ')' AS net FROM nets GROUP BY design_id, net_name) GROUP BY 1", nets=NETS))
def a26_netlist_text(spark, sf):
    from fathomgrid.sources.sinks import netlist_text

    return netlist_text(made(spark, sf, NETS))


@query("SELECT '<node id=\"' || p_partkey || '\"><data key=\"properties\">{&quot;name&quot;:&quot;' || p_name || ' &amp; &lt;co&quot;}</data></node>' AS value FROM part UNION ALL SELECT '<edge source=\"' || p_partkey || '\" target=\"' || p_size || '\"><data key=\"properties\">{&quot;w&quot;:&quot;1&quot;}</data></edge>' FROM part")
def a10_graphml_lines(spark, sf):
    from fathomgrid.sources.sinks import graphml_lines

    part = load(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").cast("string").alias("id"), F.create_map(F.lit("name"), F.concat("p_name", F.lit(" & <co"))).alias("properties"))
    edges = part.select(F.col("p_partkey").cast("string").alias("source_id"), F.col("p_size").cast("string").alias("target_id"), F.create_map(F.lit("w"), F.lit("1")).alias("properties"))
    return graphml_lines(nodes, edges)


@query(duck("SELECT design_id, string_agg(severity || ' ' || rule || ' ' || subject, chr(10) ORDER BY severity, rule, subject) AS found FROM (SELECT design_id, 'CRITICAL' AS severity, 'many' AS rule, net_name AS subject FROM nets WHERE net_name NOT LIKE 'N1%' GROUP BY ALL UNION ALL SELECT design_id, 'WARNING', 'few', net_name FROM nets WHERE net_name LIKE 'N1%' GROUP BY ALL) GROUP BY 1", nets=NETS))
def f7_findings_by_severity(spark, sf):
    from fathomgrid.sources.sinks import report_text

    nets = made(spark, sf, NETS).select("design_id", "net_name").distinct()
    of = lambda kept, severity, rule: nets.filter(kept).select("design_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("net_name").alias("subject"))
    report = report_text(made(spark, sf, BOM), of("net_name LIKE 'N1%'", "WARNING", "few").unionByName(of("net_name NOT LIKE 'N1%'", "CRITICAL", "many")))
    return report.select("design_id", F.replace(F.element_at(F.split("value", "## Findings\n\n"), -1), F.lit("- "), F.lit("")).alias("found")).filter("found <> 'none'")


def _log(spark, sf):
    from fathomgrid.streaming.review import states

    status = F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "error", "corrected").when(F.col("event_type") == "view", "rejected").otherwise("pending")
    return states(load(spark, sf, "events").select((F.col("event_id") % 700).alias("item_id"), F.col("user_id").alias("design_id"), F.lit("s").alias("stage"), status.alias("status"), F.col("event_id").cast("string").alias("payload"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq")))


_LOG = """WITH e AS (SELECT event_id % 700 AS item_id, user_id AS design_id, CASE event_type WHEN 'click' THEN 'approved' WHEN 'error' THEN 'corrected' WHEN 'view' THEN 'rejected' ELSE 'pending' END AS status, event_id, ts FROM events),
items AS (SELECT item_id, arg_min(design_id, (ts, event_id)) AS design_id, min(ts) AS created_at, coalesce(arg_min(status, (ts, event_id)) FILTER (status <> 'pending'), 'pending') AS status, arg_min(event_id, (ts, event_id)) FILTER (status <> 'pending') AS payload FROM e GROUP BY 1)"""


@query(_LOG + " SELECT item_id FROM items WHERE status = 'pending'")
def f10_pending(spark, sf):
    from fathomgrid.streaming.review import pending

    return pending(_log(spark, sf)).select("item_id")


@query(_LOG + " SELECT design_id, status, CASE WHEN status = 'corrected' THEN CAST(payload AS VARCHAR) END AS correction FROM (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY created_at DESC, item_id DESC) AS r FROM items) WHERE r = 1 AND status IN ('approved', 'corrected')")
def l4_resumable(spark, sf):
    from fathomgrid.streaming.review import resumable

    return resumable(_log(spark, sf)).select("design_id", "status", "correction")


@query("SELECT c_custkey, 'approved' AS status FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_custkey, 'pending' FROM customer WHERE c_custkey % 4 = 0")
def a7_insert_with_gate(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", F.lit("n").alias("name"), F.lit(1).alias("v"))
    given = rows.select("c_custkey", F.lit(1.0).alias("value"))
    gate = rows.select("c_custkey", (F.col("c_custkey") % 4 > 0).alias("passed"))
    stored = given.limit(0).withColumn("status", F.lit("approved"))
    return L.insert_components(rows.limit(0), stored, rows, given, gate, "c_custkey", "v")[1].select("c_custkey", "status")


@query(
    """WITH RECURSIVE b AS (SELECT user_id, event_id AS box_id, value % 50 AS x, CAST(event_id % 40 AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM events),
w AS (SELECT user_id, i, [{'x': x, 'y': y, 'id': box_id}] AS kept FROM b WHERE i = 1
UNION ALL SELECT b.user_id, b.i, CASE WHEN len(list_filter(kept, lambda k: greatest(0, 20 - abs(k.x - b.x)) * greatest(0, 20 - abs(k.y - b.y)) / (800 - greatest(0, 20 - abs(k.x - b.x)) * greatest(0, 20 - abs(k.y - b.y))) >= 0.5)) = 0 THEN list_append(kept, {'x': b.x, 'y': b.y, 'id': b.box_id}) ELSE kept END
  FROM b JOIN w ON b.user_id = w.user_id AND b.i = w.i + 1)
SELECT user_id, k.id AS box_id FROM (SELECT user_id, unnest(arg_max(kept, i)) AS k FROM w GROUP BY 1)"""
)
def g8_box_suppression(spark, sf):
    box = load(spark, sf, "events").select("user_id", F.col("event_id").alias("box_id"), (F.col("value") % 50).alias("x0"), (F.col("event_id") % 40).cast("double").alias("y0"), F.col("value").alias("confidence"))
    return J.keep_best_boxes(box.withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 20}), ["user_id"]).select("user_id", "box_id")
