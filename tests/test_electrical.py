"""Electrical checks against one net at a time in plain Python, and how often their tables are read."""

import random

from fathomgrid import registry
from fathomgrid.operators.rules import INPUTS, OUTPUTS, POWER_FUNCTIONS, REQUIRED_FUNCTIONS, electrical_checks


def one_by_one(nets, pins):
    key = lambda p: None if None in p[:3] else p[:3]
    on, out = {}, []
    for d, net, kind, ref, pin in nets:
        held = [p[3:] for p in pins if key(p) and key(p) == key((d, ref, pin))] or [(None, None)]
        on.setdefault((d, net, kind), []).extend((ref, *h) for h in held)
    for (d, net, kind), rows in on.items():
        refs = lambda fits: sorted({r for r, t, f in rows if r is not None and fits(t, f)})
        drivers, inputs, every = refs(lambda t, f: t in OUTPUTS), refs(lambda t, f: t in INPUTS and f not in POWER_FUNCTIONS), refs(lambda t, f: True)
        sourced = [True if f == "POWER_POSITIVE" else None if r is None else "regulator" in r.lower() for r, _, f in rows]
        if sum(t in OUTPUTS for _, t, _ in rows) > 1:
            out.append((d, "CRITICAL", "no_output_conflict", net, drivers))
        if net is not None and net.startswith("VCC") and True not in sourced and False in sourced:
            out.append((d, "CRITICAL", "power_net_has_source", net, every))
        if net is not None and "3V3" in net.upper() and "5V" in net.upper():
            out.append((d, "WARNING", "no_logic_level_mismatch", net, every))
        if kind not in ("power", None) and not drivers and inputs:
            out.append((d, "WARNING", "no_floating_inputs", net, inputs))
    used = {key((d, ref, pin)) for d, _, _, ref, pin in nets} - {None}
    for p in pins:
        if p[4] in REQUIRED_FUNCTIONS and key(p) not in used:
            out.append((p[0], "CRITICAL", "no_required_pin_floating", ".".join(x for x in p[1:3] if x is not None), [p[1]]))
    return sorted(out, key=repr)


def test_nulls_and_repeats(spark):
    rng = random.Random(11)
    pick = lambda *x: rng.choice(x)
    place = lambda: (pick("a", "b", None), pick("U1", "U2", "Regulator", None), pick("1", "2", "3", None))
    nets = [(d, pick("VCC", "vcc_3v3_5V", "SIG", "IN", None), pick("power", "signal", None), r, p) for d, r, p in (place() for _ in range(60))]
    pins = [(*place(), pick("output", "input", "io", "power", None), pick("POWER_POSITIVE", "POWER_GROUND", "ENABLE", "RESET", "OTHER", None)) for _ in range(40)]
    pins += pins[:10]
    made = spark.createDataFrame(nets, "design_id string, net_name string, net_type string, ref string, pin_number string")
    held = spark.createDataFrame([(*p, None) for p in pins], "design_id string, ref string, pin_number string, pin_type string, function string, role string")
    got = electrical_checks(made, held).collect()
    assert sorted(((*r[:4], r.refs) for r in got), key=repr) == one_by_one(nets, pins)
    assert {r.rule for r in got} == {"no_output_conflict", "power_net_has_source", "no_required_pin_floating", "no_logic_level_mismatch", "no_floating_inputs"}


def test_one_pass(spark):
    """Nets meet pins once, each table is read once for it, and refs that nobody asks for aren't collected."""
    plan = registry.queries()["k6_electrical_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("Join"), plan.count("collect_set")) == (2, 1, 0)
    assert plan.count("Exchange") == 3
