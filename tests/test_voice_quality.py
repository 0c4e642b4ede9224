"""Voice events against a walk over each simulation's ticks."""

import random

import pytest

from convolens.operators import voice_quality as V

TICKS = "simulation_id int, tick int, user_speaks boolean, agent_speaks boolean, backchannel boolean, vocal_tic string, non_directed string, user_text string, agent_text string"


def runs(flags):
    out, start = [], None
    for k, f in enumerate([*flags, False]):
        if f and start is None:
            start = k
        elif not f and start is not None:
            out.append((start, k))
            start = None
    return out


def walked(rows, w):
    """(category, type, error, latency, tick, transcript) of one simulation, by loops."""
    rows = [dict(zip(("sim", "tick", "u", "a", "bc", "vocal_tic", "non_directed", "ut", "at"), r)) for r in rows]
    if len(rows) > 1 and rows[-1]["u"] and not rows[-2]["u"]:
        rows = rows[:-1]
    user, agent = runs([r["u"] for r in rows]), runs([r["a"] for r in rows])
    said = lambda key, s, e: "".join(r[key] or "" for r in rows[s:e])
    t, whole, out = w.tick_seconds, lambda s: int(s / w.tick_seconds), []
    aside = lambda s, e, name: any(r[name] is not None for r in rows[s:e])
    turns = [(s, e) for s, e in user if not rows[s]["bc"] and not rows[e - 1]["a"]]
    for k, (s, e) in enumerate(turns):
        nxt = next((a for a, _ in agent if a >= e), None)
        again = turns[k + 1][0] if k + 1 < len(turns) else None
        if nxt is not None and (again is None or nxt <= again):
            out.append(("response", "response", False, nxt * t - e * t, e, said("ut", s, e)))
        elif again is not None:
            out.append(("response", "no_response", True, None, e, said("ut", s, e)))

    def answer(name, s, e, text, seconds):
        hit = next(((a, b) for a, b in agent if s <= a <= e + whole(seconds)), None)
        out.append((name, f"{name}_error", True, None, hit[0], said("at", *hit)) if hit else (name, f"{name}_correct", False, None, s, text))

    for s, e in user:
        if rows[s]["a"]:
            name, seconds = next(((n, x) for n, on, x in (("backchannel", rows[s]["bc"], w.backchannel_yield), ("vocal_tic", aside(s, e, "vocal_tic"), w.vocal_tic_yield), ("non_directed", aside(s, e, "non_directed"), w.non_directed_yield)) if on), ("yield", w.no_yield))
            quiet = next((i for i in range(s, min(s + whole(seconds), len(rows))) if not rows[i]["a"]), None)
            if name == "yield":
                out.append(("yield", "yield", False, (quiet - s) * t, s, said("ut", s, e)) if quiet is not None else ("yield", "no_yield", True, None, s, said("ut", s, e)))
            else:
                out.append((name, f"{name}_error" if quiet is not None else f"{name}_correct", quiet is not None, None, s, said("ut", s, e)))
        elif aside(s, e, "vocal_tic"):
            answer("vocal_tic", s, e, said("ut", s, e), w.vocal_tic_response)
        elif aside(s, e, "non_directed"):
            answer("non_directed", s, e, said("ut", s, e), w.non_directed_response)
    for name, stop, wait in (("vocal_tic", w.vocal_tic_yield, w.vocal_tic_response), ("non_directed", w.non_directed_yield, w.non_directed_response)):
        held = [None if r["u"] else r[name] for r in rows]
        starts = [k for k, x in enumerate(held) if x is not None and (k == 0 or held[k - 1] != x)]
        for s in starts:
            e = next((k for k in range(s, len(rows)) if held[k] != held[s]), len(rows))
            speaking = next(((a, b) for a, b in agent if a <= s < b), None)
            if speaking is None:
                answer(name, s, e, held[s], wait)
            elif (speaking[1] - s) * t <= stop:
                out.append((name, f"{name}_error", True, None, s, held[s]))
    return out


def simulated(seed, sims=25):
    rng, rows = random.Random(seed), []
    for sim in range(sims):
        u = a = False
        for tick in range(rng.randrange(1, 80)):
            u, a = u ^ (rng.random() < 0.25), a ^ (rng.random() < 0.2)
            pick = lambda p, *x: rng.choice(x) if rng.random() < p else None
            rows.append((sim, tick, u, a, rng.random() < 0.2, pick(0.2, "cough", "um"), pick(0.2, "hold on"), pick(0.7, "x", "y"), pick(0.7, "p", "q")))
    return rows


@pytest.mark.parametrize("windows", [V.Windows(), V.Windows(0.5, 3.0, 1.0, 0.5, 2.0, 1.0, 0.4)])
def test_events_equal_a_walk(spark, windows):
    rows = simulated(5)
    got = V.quality_events(spark.createDataFrame(rows, TICKS), windows=windows)
    assert tuple(got.columns) == V.COLUMNS
    show = lambda sim, e: (sim, e[0], e[1], e[2], None if e[3] is None else round(e[3], 6), e[4], e[5])
    found = sorted((show(r.simulation_id, (r.event_category, r.event_type, r.is_error, r.latency_sec, r.event_tick, r.transcript)) for r in got.collect()), key=str)
    by_sim = {}
    for r in rows:
        by_sim.setdefault(r[0], []).append(r)
    wanted = sorted((show(sim, e) for sim, own in by_sim.items() for e in walked(own, windows)), key=str)
    assert found == wanted
    assert len({w[2] for w in wanted}) == 10


def test_windows_take_the_plain_quotient():
    assert V.Windows().ticks(0.6) == 2 and V.Windows().ticks(1.0) == 5 and V.Windows().ticks(0.35) == 1


def test_ticks_without_extra_columns_and_without_rows(spark):
    plain = "simulation_id int, tick int, user_speaks boolean, agent_speaks boolean"
    rows = [(1, k, c == "u", c == "a") for k, c in enumerate("uuuuu-----aaaaa-----")] + [(2, 0, True, None)]
    got = V.quality_events(spark.createDataFrame(rows, plain)).collect()
    assert [(r.event_type, round(r.latency_sec, 6), r.event_tick, r.llm, r.transcript) for r in got] == [("response", 1.0, 5, "", "")]
    assert V.quality_events(spark.createDataFrame([], plain)).count() == 0


def test_panel_and_means_over_domains(spark):
    plain = "simulation_id int, tick int, user_speaks boolean, agent_speaks boolean"
    patterns = {1: "uu--aa--", 2: "uu----uu--aa", 3: "aabbaa--"}  # b: both
    rows = [(sim, k, c in "ub", c in "ab") for sim, p in patterns.items() for k, c in enumerate(p)]
    sims = spark.createDataFrame([(1, "m", "x"), (2, "m", "y"), (3, "m", "z")], "simulation_id int, llm string, domain string")
    panels = V.panel(spark.createDataFrame(rows, plain), sims)
    by = {r.domain: r for r in panels.collect()}
    assert (by["x"].response_rate, by["y"].response_rate, by["z"].response_rate) == (1.0, 0.5, None)
    assert by["z"].yield_rate == 1.0 and by["z"].agent_interruption_rate is None and by["x"].selectivity_vocal_tic is None and by["z"].response_total == 0
    whole = V.over_domains(panels).first()
    assert (whole.domains, whole.response_rate, whole.yield_rate, whole.response_total, whole.n_simulations) == (3, 0.75, 1.0, 3, 3)
    assert V.over_domains(panels, least=2).first().response_rate is None
