"""Nets, blocks and assembled designs from pins and bills of material, for all designs at once.

pins(design_id, ref, pin_number, pin_name, function, confidence, part_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.functions.text import contains_any, supply_net

#: Net names of functions, and how bus functions are joined.
NET_NAMES = {
    "SPI_CLOCK": "SPI_SCK", "SPI_DATA_IN": "SPI_MOSI", "SPI_DATA_OUT": "SPI_MISO", "SPI_CHIP_SELECT": "SPI_CS", "I2C_DATA": "I2C_SDA", "I2C_CLOCK": "I2C_SCL", "UART_TRANSMIT": "UART_TX", "UART_RECEIVE": "UART_RX",
    "ENABLE": "EN", "RESET": "NRST", "INTERRUPT": "INT", "PWM_OUTPUT": "PWM", "FEEDBACK": "FB", "SWITCH_NODE": "SW", "ANALOG_OUTPUT": "ANALOG_OUT", "RF_OUTPUT": "RF_OUT",
}
UNIQUE = ("SPI_CHIP_SELECT",)
POWER = ("POWER_POSITIVE", "POWER_GROUND", "POWER_INPUT")
REGULATORS = ("regulator", "ldo", "buck", "boost", "converter")
BLOCKS = {
    "power": ("regulator", "ldo", "buck", "boost", "converter", "charger"),
    "RF": ("antenna", "rf", "bluetooth", "wifi", "lora", "wireless"),
    "digital": ("microcontroller", "mcu", "processor", "fpga", "gate", "flip"),
    "analog": ("op_amp", "opamp", "adc", "dac", "comparator", "amplifier"),
    "passive": ("capacitor", "resistor", "inductor", "crystal", "fuse"),
}

_OUT = ("design_id", "net_name", "net_type", "ref", "pin_number", "confidence")


def _net_type(function: Column) -> Column:
    return F.when(function.isin("SPI_CLOCK", "I2C_CLOCK"), "clock").when(F.startswith(function, F.lit("RF_")), "RF").otherwise("signal")


def power_nets(pins: DataFrame) -> DataFrame:
    """One row a pin: VCC (one for each regulator's voltage if there are several regulators), GND and VIN."""
    regulator = contains_any(F.col("part_text"), REGULATORS)
    many = pins.groupBy("design_id").agg((F.count_distinct(F.when(regulator, F.col("ref"))) > 1).alias("many"))
    rows = pins.filter(F.col("function").isin(*POWER)).join(many, "design_id")
    name = F.when(F.col("function") == "POWER_GROUND", "GND").when(F.col("function") == "POWER_INPUT", "VIN").when(F.col("many") & regulator, supply_net(F.col("part_text"))).otherwise("VCC")
    return rows.select("design_id", name.alias("net_name"), F.lit("power").alias("net_type"), "ref", "pin_number", "confidence")


def signal_nets(pins: DataFrame) -> DataFrame:
    """One row a pin: functions share a net, chip selects get one each, transmitters cross to the receivers of other parts."""
    rows = pins.filter(F.col("function").isNotNull() & ~F.col("function").isin("NO_CONNECT", *POWER))
    base = F.coalesce(*(F.when(F.col("function") == k, F.lit(v)) for k, v in NET_NAMES.items()), F.col("function"))
    name = F.when(F.col("function").isin(*UNIQUE), F.concat_ws("_", base, "ref")).otherwise(base)
    plain = rows.filter(~F.col("function").isin("UART_TRANSMIT", "UART_RECEIVE")).select("design_id", name.alias("net_name"), _net_type(F.col("function")).alias("net_type"), "ref", "pin_number", "confidence")
    end = lambda function, side: rows.filter(F.col("function") == function).select("design_id", F.col("ref").alias(f"{side}_ref"), F.struct("ref", "pin_number", "confidence").alias(side))
    crossed = end("UART_TRANSMIT", "tx").join(end("UART_RECEIVE", "rx"), "design_id").filter("tx_ref <> rx_ref")
    uart = crossed.select("design_id", F.concat_ws("_", F.lit("UART"), "tx_ref", "rx_ref").alias("net_name"), F.lit("signal").alias("net_type"), F.explode(F.array("tx", "rx")).alias("p")).select("design_id", "net_name", "net_type", "p.*")
    return plain.select(*_OUT).unionByName(uart.select(*_OUT))


def net_confidence(nets: DataFrame) -> DataFrame:
    """Mean confidence of a net's pins, 0.5 without any known."""
    return nets.groupBy("design_id", "net_name").agg(F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("net_confidence"))


def design_confidence(nets: DataFrame) -> DataFrame:
    return net_confidence(nets).groupBy("design_id").agg(F.round(F.coalesce(F.avg("net_confidence"), F.lit(0.0)), 4).alias("confidence"))


def passive_nets(bom: DataFrame, pins: DataFrame, nets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nets, unresolved)`` of bypass capacitors, power inductors and pull-up resistors.

    ``bom(design_id, ref, component_type, justification)``; the first two pins of a part
    by number are used. Parts of other kinds, and those without pins, are unresolved.
    """
    low = F.lower("component_type")
    kind = F.when(F.contains(low, F.lit("capacitor")) & contains_any(low, ("decoupling", "bypass")), "bypass").when(F.contains(low, F.lit("inductor")) & F.contains(low, F.lit("power")), "inductor").when(F.contains(low, F.lit("resistor")) & contains_any(low, ("pull-up", "pullup", "pull_up")), "pullup")
    names = nets.groupBy("design_id").agg(F.collect_set("net_name").alias("names"))
    prefer = lambda options: F.coalesce(*(F.when(F.array_contains("names", o), F.lit(o)) for o in options))
    two = pins.groupBy("design_id", "ref").agg(F.slice(F.array_sort(F.collect_list(F.struct("pin_number", "confidence"))), 1, 2).alias("pins"))
    rows = bom.withColumn("kind", kind).join(names, "design_id", "left").join(two, ["design_id", "ref"], "left")
    vcc = prefer(("VCC", "VCC_3V3", "VCC_3p3V", "VCC_5V"))
    near = F.regexp_extract("justification", r"\b([CRU]\d+)\b", 1)
    bypass = F.when(near != "", F.concat(F.lit("VCC_"), near, F.lit("_BYPASS"))).otherwise(vcc)
    first = F.when(F.col("kind") == "bypass", bypass).when(F.col("kind") == "inductor", F.concat("ref", F.lit("_L_IN"))).when(F.col("kind") == "pullup", vcc)
    second = F.when(F.col("kind") == "bypass", F.concat(bypass, F.lit("_GND"))).when(F.col("kind") == "inductor", F.concat("ref", F.lit("_L_OUT"))).when(F.col("kind") == "pullup", F.concat("ref", F.lit("_PULLUP")))
    rows = rows.withColumns({"n1": first, "n2": second})
    usable = F.col("kind").isNotNull() & F.col("n1").isNotNull() & F.col("pins").isNotNull()
    ends = F.array(F.struct(F.col("n1").alias("net_name"), F.get("pins", F.lit(0)).alias("p")), F.struct(F.col("n2").alias("net_name"), F.coalesce(F.get("pins", F.lit(1)), F.get("pins", F.lit(0))).alias("p")))
    made = rows.filter(usable).select("design_id", "ref", F.explode(ends).alias("e")).select("design_id", "e.net_name", F.lit("power").alias("net_type"), "ref", "e.p.pin_number", "e.p.confidence")
    return made.select(*_OUT), rows.filter(~usable).select("design_id", "ref", "component_type")


def blocks(bom: DataFrame, nets: DataFrame) -> DataFrame:
    """Functional blocks: by type, parts of no type on a bus count as digital; sorted refs; RF and analog are set apart."""
    own = F.coalesce(*(F.when(contains_any(F.col("component_type"), words), F.lit(b)) for b, words in BLOCKS.items()))
    bus = nets.filter(F.rlike("net_name", F.lit("^(SPI|I2C|UART)_"))).select("design_id", "ref").distinct().withColumn("bus", F.lit(True))
    kind = F.coalesce(own, F.when(F.col("bus"), F.lit("digital")), F.lit("mixed"))
    rows = bom.join(bus, ["design_id", "ref"], "left").withColumn("block_type", kind)
    return rows.groupBy("design_id", "block_type").agg(F.array_sort(F.collect_list("ref")).alias("refs")).withColumns({"name": F.concat("block_type", F.lit("_block")), "isolation": F.col("block_type").isin("RF", "analog")})


def routing_hints(nets: DataFrame, boards: DataFrame) -> DataFrame:
    """Hints by net type; RF traces get a width by the board's material."""
    per = nets.select("design_id", "net_name", "net_type").distinct().join(boards, "design_id", "left")
    hint = F.when(F.col("net_type") == "RF", "impedance_controlled").when(F.col("net_type") == "clock", "isolation").when(F.col("net_type") == "differential", "length_matched")
    width = F.when(F.col("net_type") == "RF", F.when(F.contains("material", F.lit("Rogers_4003C")), 0.35).otherwise(2.0))
    return per.select("design_id", "net_name", hint.alias("hint"), width.alias("width_mm")).filter("hint IS NOT NULL")


def assemble(bom: DataFrame, sheets: DataFrame, flags: DataFrame) -> DataFrame:
    """One row a component with what its data sheet gives, defaults where there is none, and its flags.

    ``sheets(part, footprint, datasheet_confidence)``, ``flags(design_id, ref, flag)``.
    """
    per = flags.groupBy("design_id", "ref").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    out = bom.join(sheets, "part", "left").join(per, ["design_id", "ref"], "left")
    return out.select("design_id", "ref", "component_type", "part", F.coalesce("footprint", F.lit("UNKNOWN")).alias("footprint"), F.coalesce("datasheet_confidence", F.lit(0.0)).alias("datasheet_confidence"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


def merge_constraints(from_sheet: DataFrame, from_graph: DataFrame) -> DataFrame:
    """Placement constraints of data sheets, and those of the graph for pairs that no sheet names."""
    known = from_sheet.select("design_id", "ref", "relative_to").distinct()
    return from_sheet.unionByName(from_graph.join(known, ["design_id", "ref", "relative_to"], "left_anti"))


def grid_quality(cells: DataFrame) -> DataFrame:
    """Score of a grid: enough cells, few empty ones, a header and more than one row, a quarter each."""
    per = cells.groupBy("grid_id").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.bool_or("is_header").alias("header"), (F.max("row") + 1).alias("rows"))
    many = F.when(F.col("n") > 4, 1.0).otherwise(F.col("n") / 4)
    share = F.col("empty") / F.col("n")
    full = F.when(share < 0.3, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (share - 0.3) * 2))
    return per.select("grid_id", F.round((many + full + F.when(F.col("header"), 1.0).otherwise(0.0) + F.when(F.col("rows") > 1, 1.0).otherwise(0.0)) * 0.25, 4).alias("score"))
