"""Operators against brute force on small random inputs, and their edge rules."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from seasonframe.operators import aggregates as agg
from seasonframe.operators import incremental as inc
from seasonframe.operators import joins as jn
from seasonframe.operators import names as nm
from seasonframe.operators import ranking as rk
from seasonframe.operators import retrieval as rt
from seasonframe.operators import rosters as ro


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_competition_rank_with_a_hot_tie(spark):
    """A third of the rows share one value and one group holds most rows."""
    rng = random.Random(1)
    data = [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"),
             None if rng.random() < 0.33 else round(rng.uniform(-5, 5), 1)) for i in range(600)]
    df = spark.createDataFrame(data, "id int, g string, v double")
    for desc in (False, True):
        out = rk.competition_ranks(df, "v", {"overall": [], "inside": ["g"]}, desc)
        assert out.count() == len(data)
        for r in out.collect():
            mine = r["v"] or 0.0
            before = [(g, v or 0.0) for _, g, v in data if ((v or 0.0) > mine if desc else (v or 0.0) < mine)]
            assert r["overall"] == 1 + len(before)
            assert r["inside"] == 1 + sum(g == r["g"] for g, _ in before)


def test_asof_forward_matches_brute_force(spark):
    rng = random.Random(2)
    base = 20000
    left = [(i, rng.choice(["hot"] * 5 + ["x"]), base + rng.randrange(400)) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "x", "y"]), base + rng.randrange(380), f"p{i:03d}") for i in range(120)]
    day = lambda c: F.date_from_unix_date(F.col(c))
    l = spark.createDataFrame(left, "id int, g string, d int").withColumn("t", day("d")).drop("d")
    r = spark.createDataFrame(right, "g string, d int, p string").withColumn("u", day("d")).drop("d")
    got = {a: (str(b), c) for a, b, c in rows(jn.asof_forward(l, r, ["g"], "t", "u", ["p"]).select("id", "u", "p"))}
    want = {}
    for i, g, t in left:
        later = sorted((u, p) for h, u, p in right if h == g and u >= t)
        if later:
            want[i] = later[0]
    assert set(got) == set(want)
    from datetime import date, timedelta

    assert got == {i: (str(date(1970, 1, 1) + timedelta(days=u)), p) for i, (u, p) in want.items()}


def test_best_lineup_matches_brute_force(spark):
    rng = random.Random(3)
    need = {"QB": 1, "RB": 1, "WR": 1, "FLEX": 1, "SUPER_FLEX": 1}
    players, slots = [], []
    for roster in range(25):
        for i in range(rng.randrange(2, 7)):
            players.append((roster, f"p{i}", rng.choice(["QB", "RB", "WR", "TE"]), round(rng.uniform(-3, 20), 1), rng.random() < 0.85))
        slots += [(roster, s, n) for s, n in need.items()]
    p = spark.createDataFrame(players, "roster int, player_id string, position string, points double, usable boolean").withColumn(
        "locked_slot", F.lit(None).cast("string"))
    s = spark.createDataFrame(slots, "roster int, slot_type string, n_slots int")
    lineup, skipped = ro.best_lineup(p, s, ["roster"])
    assert skipped.count() == 0
    got = {}
    for r in lineup.collect():
        n, total = got.get(r["roster"], (0, 0.0))
        got[r["roster"]] = (n + 1, total + r["points"])
    fits = lambda pos, slot: pos == slot or pos in ro.FLEX_ELIGIBILITY.get(slot, [])
    for roster in range(25):
        mine = [(pos, pts) for ro_, _, pos, pts, ok in players if ro_ == roster and ok]
        best = (0, 0.0)
        for pick in product([None, *range(len(mine))], repeat=len(need)):
            used = [x for x in pick if x is not None]
            if len(used) != len(set(used)):
                continue
            if all(x is None or fits(mine[x][0], slot) for x, slot in zip(pick, need)):
                best = max(best, (len(used), sum(mine[x][1] for x in used)))
        have = got.get(roster, (0, 0.0))
        assert have[0] == best[0] and abs(have[1] - best[1]) < 1e-6


def test_best_lineup_pins_locked_and_reports_overlap(spark):
    p = spark.createDataFrame(
        [(1, "a", "RB", 1.0, True, "RB"), (1, "b", "RB", 9.0, True, None), (2, "c", "WR", 3.0, True, None)],
        "roster int, player_id string, position string, points double, usable boolean, locked_slot string")
    s = spark.createDataFrame([(1, "RB", 1), (1, "FLEX", 1), (2, "REC_FLEX", 1), (2, "WRRB_FLEX", 1)],
                              "roster int, slot_type string, n_slots int")
    lineup, skipped = ro.best_lineup(p, s, ["roster"])
    assert rows(lineup.select("player_id", "slot_type"), "player_id") == [("a", "RB"), ("b", "FLEX")]
    assert rows(skipped) == [(2,)]


def compose_by_hand(items, limit, strategy, entities):
    bonus = rt.RELATION_BONUS
    usable = [x for x in items if x["relation"] != "irrelevant"]
    ranked = sorted(usable, key=lambda x: (-(x["score"] + bonus[x["relation"]]), x["rank"]))
    chosen = []

    def add(x):
        ids = [c["doc"] for c in chosen]
        if x and x["doc"] not in ids and x["redundant"] not in ids:
            chosen.append(x)

    if strategy == "timeline":
        for role in ("baseline", "current"):
            add(next((x for x in ranked if x["role"] == role), None))
    if strategy == "per_entity":
        for e in entities:
            add(next((x for x in ranked if e in x["names"]), None))
    for x in ranked:
        if len(chosen) >= limit:
            break
        add(x)
    chosen = chosen[:limit]
    if strategy == "timeline":
        chosen.sort(key=lambda x: x["published"])
    return [x["doc"] for x in chosen]


@pytest.mark.parametrize("strategy", ["best", "timeline", "per_entity"])
def test_compose_matches_hand_rule(spark, strategy):
    rng = random.Random(4)
    by_query, hits, judgments = {}, [], []
    for q in range(20):
        n = rng.randrange(1, 15)
        docs = [f"d{i}" for i in range(n)]
        times = rng.sample(range(100), n)
        items = []
        for i, doc in enumerate(docs):
            x = {"doc": doc, "rank": i + 1, "published": times[i], "names": rng.sample(["e1", "e2", "e3"], rng.randrange(3)),
                 "score": rng.randrange(100), "relation": rng.choice(list(rt.RELATION_BONUS)),
                 "role": rng.choice(["baseline", "current", "other"]),
                 "redundant": rng.choice([d for d in docs if d != doc]) if n > 1 and rng.random() < 0.4 else None}
            items.append(x)
            hits.append((q, doc, i + 1, times[i], x["names"]))
            judgments.append((q, doc, x["score"], x["relation"], x["role"], x["redundant"]))
        by_query[q] = items
    h = spark.createDataFrame(hits, "q int, doc string, rank int, published_at int, names array<string>")
    j = spark.createDataFrame(judgments, "q int, doc string, score int, relation string, role string, redundant_with string")
    order = ["e2", "e1", "e3"]
    e = spark.createDataFrame([(q, n, i) for q in by_query for i, n in enumerate(order)], "q int, entity string, priority int")
    out = rt.adjust_and_compose(h, j, "q", "doc", 5, strategy=strategy, entities=e)
    got = {}
    for q, doc in rows(out.orderBy("q", "place").select("q", "doc")):
        got.setdefault(q, []).append(doc)
    for q, items in by_query.items():
        assert got.get(q, []) == compose_by_hand(items, 5, strategy, order)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_candidates_finds_every_pair(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
    left, right = sorted({word() for _ in range(80)}), sorted({word() for _ in range(60)})
    l = spark.createDataFrame([(x,) for x in left], "key string")
    r = spark.createDataFrame([(x,) for x in right], "alias string")
    out = nm.edit_candidates(l, "key", r, "alias", F.greatest(F.lit(2), F.floor(F.length("key") / 3)))
    want = {(a, b, edit_distance(a, b)) for a in left for b in right if edit_distance(a, b) <= max(2, len(a) // 3)}
    assert set(rows(out.select("key", "alias", "distance"))) == want


def nearest_by_hand(keys, names, k):
    out = set()
    for key in keys:
        best = {}
        for alias, code in names:
            d = edit_distance(key, alias)
            if d <= max(2, len(key) // 3):
                best[code] = min(d, best.get(code, d))
        ranked = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
        out |= {(key, code, d, i) for i, (code, d) in enumerate(ranked, 1)}
    return out


def test_nearest_codes_against_all_pairs(spark):
    """Lengths on both sides of the pattern limit, empty keys and aliases, codes with many aliases, ties by code."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 13)))
    keys = sorted({word() for _ in range(120)} | {"", "a", "ab"})
    names = sorted({(word(), f"c{rng.randrange(40):02d}") for _ in range(150)} | {("", "c09"), ("ab", "c01"), ("ab", "c02")})
    l, r = spark.createDataFrame([(x,) for x in [*keys, None]], "key string"), spark.createDataFrame(names, "alias string, code string")
    for k in (1, 3):
        got = rows(nm.nearest_codes(l, "key", r, "alias", "code", k).select("key", "code", "distance", "place"))
        assert len(got) == len(set(got)) and set(got) == nearest_by_hand(keys, names, k)
    nothing = nm.nearest_codes(l, "key", r.limit(0), "alias", "code", 3)
    assert nothing.count() == 0 and nm.nearest_codes(l.limit(0), "key", r, "alias", "code", 3).count() == 0


def test_short_texts_do_not_meet_all_short_aliases(spark):
    """Two-letter texts are within two edits of every two-letter alias; the join writes the same rows for 25 and 600."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    two = [a + b for a in letters for b in letters]
    keys = [a + b for a in "01234567" for b in "01234567"]
    l = spark.createDataFrame([(x,) for x in keys], "key string")
    for n in (25, 600):
        names = [(x, f"c{i:03d}") for i, x in enumerate(two[:n])]
        r = spark.createDataFrame(names, "alias string, code string")
        # No letter in common: only the pattern of two blanks, and three codes for it.
        assert nm.pattern_candidates(l, "key", r, "alias", "code", 2, 3).count() == 3 * len(keys)
        got = rows(nm.nearest_codes(l, "key", r, "alias", "code", 3).select("key", "code", "distance", "place"))
        assert set(got) == {(x, f"c{i:03d}", 2, i + 1) for x in keys for i in range(3)}


def test_state_changes_across_buckets(spark):
    rng = random.Random(6)
    data = sorted({(rng.choice(["hot"] * 4 + ["b"]), rng.randrange(10**6)): rng.choice(["x", "y", None]) for _ in range(300)}.items())
    df = spark.createDataFrame([(e, t, s) for (e, t), s in data], "e string, t long, s string").withColumn("t", F.timestamp_seconds("t"))
    got = {(r["e"], r["t"].timestamp(), r["previous_s"]) for r in inc.state_changes(df, ["e"], "t", ["s"]).collect()}
    want, last = set(), {}
    for (e, t), s in data:
        if e in last and last[e] != s:
            want.add((e, float(t), last[e]))
        last[e] = s
    assert got == want


def test_rolling_quota_is_strict(spark):
    day = 86400
    runs = [(1, 0.0, 5), (2, day - 0.000001, 7), (3, float(day), 1), (4, float(day) + 1, 1), (5, float(day), 2)]
    df = spark.createDataFrame(runs, "id int, s double, n int").select("id", F.lit("p").alias("p"), F.timestamp_seconds("s").alias("t"), "n")
    out = dict(rows(agg.rolling_quota(df, "p", "t", "n", 10).select("id", "used_24h")))
    assert out == {1: 0, 2: 5, 3: 7, 5: 7, 4: 10}


def test_season_totals_edges(spark):
    data = [("a", 1, 10, "X", None, 0), ("a", 2, 11, "Y", None, 0), ("a", 2, 12, "X", None, None), ("b", 1, 13, None, 4.0, 2)]
    df = spark.createDataFrame(data, "e string, week int, game int, team string, epa double, n int")
    out = agg.season_totals(df, ["e"], ["week", "game"], "game", ["epa", "n"], ["team"], "team", null_unless={"epa": "n"})
    a, b = out.orderBy("e").collect()
    assert (a["games"], a["epa"], a["n"], a["teams"], a["last_team"]) == (3, None, 0, ["X", "Y"], "X")
    assert (b["games"], b["epa"], b["teams"], b["last_team"]) == (1, 4.0, [None], None)


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert agg.assert_unique(df, ["k", "v"], "t").count() == 3
    with pytest.raises(Exception, match="repeated key"):
        agg.assert_unique(df, ["k"], "t").collect()


def test_threshold_counts_missing_weeks_as_zero(spark):
    facts = spark.createDataFrame([("p", 1, "QB", 10.0, 2.0), ("p", 2, "QB", None, 1.0), ("p", 3, "QB", 4.0, 0.0)],
                                  "e string, week int, pos string, y double, a double")
    part = spark.createDataFrame([("p", 1, "QB", "ACT"), ("p", 4, "WR", "ACT"), ("p", 5, "TE", "RES"), ("q", 1, "K", "RES")],
                                 "e string, week int, pos string, status string")
    run = lambda f, basis: {r["e"]: r for r in agg.threshold_analysis(
        facts, part, ["e"], "week", ["pos"], f, ["y", "a"], "gte", 5, basis).collect()}
    r = run("y", "active_roster")["p"]
    assert (r["denominator_games"], r["qualifying_weeks"], r["average"], r["median"], r["pos"]) == (2, [1], 5.0, 5.0, "WR")
    r = run("y / a", "stat_row")["p"]
    assert (r["evaluated_games"], r["undefined_weeks"], r["qualifying_rate"]) == (1, [2, 3], 1 / 3)
    r = run("y / a", "team_games")
    assert (r["p"]["undefined_weeks"], r["p"]["pos"]) == ([4, 5], "TE")
    r = run("y", "active_roster")["q"]
    assert (r["denominator_games"], r["qualifying_rate"], r["average"], r["pos"]) == (0, None, None, None)


def test_token_cost(spark):
    calls = [("a", "gpt-5.6-luna", 1_000_000, 500_000, 0), ("a", "GPT-5.6", 0, 0, 1_000_000), ("b", "other", 10, 0, 0),
             ("b", "gpt-5.6-terra-x", 10, 0, 0), ("c", "other", 0, 0, 0), ("d", "gpt-5.6-terra-2026", 100, 900, -5)]
    df = spark.createDataFrame(calls, "k string, model string, input_tokens long, cached_input_tokens long, output_tokens long")
    out = {r["k"]: r["cost_usd"] for r in agg.token_cost(df, ["k"]).collect()}
    assert out["a"] == pytest.approx(0.1 + 0.01 + 20.0) and out["b"] is None and "c" not in out
    assert out["d"] == pytest.approx(100 * 0.2 / 1e6)


def test_formula_ranking_ties_and_limits(spark):
    df = spark.createDataFrame([(3, 4.0, 2.0), (1, 2.0, 1.0), (2, None, 1.0), (4, 1.0, 0.0)], "id int, a double, b double")
    r = rk.rank_by_formula(df, "a / b", ["a", "b"], "id")
    assert rows(r.results.select("rank", "id", "metric_value"), "rank") == [(1, 1, 2.0), (2, 3, 2.0)]
    assert rows(r.zero_denominator.select("id")) == [(4,)]
    assert rows(r.counts) == [(4, 1, 1)]
    for bad in ({"limit": 0}, {"direction": "up"}, {"minimum": ("z", 1)}):
        with pytest.raises(ValueError):
            rk.rank_by_formula(df, "a / b", ["a", "b"], "id", **bad)


def test_leaderboard_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id int, v int")
    for direction, ids in (("asc", [3, 2, 1]), ("desc", [2, 3, 1])):
        assert [r["id"] for r in rk.leaderboard(df, "v", "id", direction).orderBy("place").collect()] == ids


def test_open_slots(spark):
    picks = [(1, p) for p in ["RB", "RB", "RB", "WR", "QB", "QB"]]
    need = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "FLEX": 1, "SUPER_FLEX": 1}
    r = ro.open_slots(spark.createDataFrame(picks, "r int, position string"), ["r"], "position", need).first()
    assert [r[f"open_{p}"] for p in need] == [0, 0, 1, 1, 0, 0]


def test_keyword_search_stop_words_and_filters(spark):
    docs = spark.createDataFrame([(1, "Knee injury", "The knee is sore"), (2, "Trade", "was it the knee"), (3, "x", "the who")],
                                 "id int, title string, body string")
    q = spark.createDataFrame([("a", "what is the KNEE"), ("b", "who was it"), ("c", "zebra")], "q string, text string")
    out = rt.keyword_search(docs, "id", {"title": F.col("title"), "content": F.col("body")}, q, "q", "text", 5)
    got = {}
    for r in out.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got["a"] == [1, 2] and set(got["b"]) == {2, 3} and "c" not in got


def test_vector_search_rules(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [0.0, 0.0], "m"), (3, [1.0, 1.0], "n")], "id int, v array<float>, model string")
    q = spark.createDataFrame([("a", [1.0, 0.0], "m")], "q string, w array<float>, model string")
    assert rows(rt.vector_search(docs, "id", "v", q, "q", "w", 5).select("id", "score"), "id") == [(1, 1.0), (2, 0.0)]
    longer = spark.createDataFrame([("a", [1.0, 0.0, 1.0], "m")], "q string, w array<float>, model string")
    with pytest.raises(Exception, match="dimension"):
        rt.vector_search(docs, "id", "v", longer, "q", "w", 5).collect()


def test_name_tiers(spark):
    catalog = spark.createDataFrame(
        [("1", "A.J. Brown", "PHI"), ("2", "Marvin Harrison Jr.", "ARI"), ("3", "Marvin Harrison", "IND"),
         ("4", "Mike Williams", "NYJ"), ("5", "Mike Williams", "TB"), ("6", "Patrick Mahomes II", "KC")],
        "player_id string, display_name string, team string")
    refs = spark.createDataFrame(
        [(1, "AJ Brown", None), (2, "Marvin Harrison", None), (3, "mike williams", "TB"), (4, "Mike Williams", None),
         (5, "Patrick Mahomes", None), (6, "P. Mahomes", None), (7, "Nobody Here", None)], "ref_id int, name string, team string")
    out = {r["ref_id"]: (r["status"], r["basis"], r["player_id"]) for r in nm.resolve_names(refs, catalog, True).collect()}
    assert out == {
        1: ("resolved", "exact", "1"), 2: ("resolved", "exact", "3"), 3: ("resolved", "exact", "5"),
        4: ("ambiguous", "exact", None), 5: ("resolved", "plain", "6"), 6: ("resolved", "surname", "6"),
        7: ("not_found", None, None)}


def test_every_ambiguous_reference_lists_its_candidates(spark):
    catalog = spark.createDataFrame(
        [("1", "Al Bo", "x"), ("2", "al bo", "y"), ("3", "Cy Do Jr.", "x"), ("4", "Cy Do Sr.", "y"), ("5", "Ed Fix", "x"),
         ("6", "Gus Fix", "y"), ("7", "Hal Ivory", "x")], "player_id string, display_name string, team string")
    refs = spark.createDataFrame(
        [(1, "AL BO"), (2, "Cy Do"), (3, "Zed Fix"), (4, "fix"), (5, "Hal Ivory"), (6, "none"), (7, None),
         (8, "0000abcd-0000-4000-8000-000000000000")], "ref_id long, name string")
    resolved, candidates = nm.resolve_references(refs, catalog)
    assert sorted(rows(candidates.select("ref_id", "basis", "player_id"))) == [
        (1, "exact", "1"), (1, "exact", "2"), (2, "plain", "3"), (2, "plain", "4"),
        (3, "partial", "5"), (3, "partial", "6"), (4, "partial", "5"), (4, "partial", "6")]
    counts = {r.ref_id: r.n_candidates for r in resolved.filter("status = 'ambiguous'").collect()}
    assert counts == {1: 2, 2: 2, 3: 2, 4: 2}


def test_references_by_a_part_of_a_name_and_any_uuid(spark):
    catalog = spark.createDataFrame(
        [("1", "Marquise Brown", "x"), ("2", "Zed Browning", "y"), ("3", "Jaxon Smith-Njigba", "x"), ("4", "Ann Lee", "y")],
        "player_id string, display_name string, team string")
    plain = "0000abcd-0000-4000-8000-00000000000f"
    spelled = [plain.upper(), plain.replace("-", ""), "{" + plain + "}", "urn:uuid:" + plain, f"  {plain} "]
    refs = spark.createDataFrame(
        [(1, "Zeke Brown"), (2, "Jason Smith"), (3, "Bob Lee Jr."), (4, "Bob Leeds"), *[(10 + i, u) for i, u in enumerate(spelled)], (20, plain[:-1])],
        "ref_id long, name string")
    resolved, candidates = nm.resolve_references(refs, catalog)
    got = {r.ref_id: (r.status, r.basis, r.player_id) for r in resolved.collect()}
    assert got == {
        1: ("ambiguous", "partial", None), 2: ("resolved", "partial", "3"), 3: ("resolved", "partial", "4"), 4: ("not_found", None, None),
        **{10 + i: ("resolved", "uuid", plain) for i in range(len(spelled))}, 20: ("not_found", None, None)}
    assert sorted(rows(candidates.select("ref_id", "player_id"))) == [(1, "1"), (1, "2")]


def test_references_of_one_and_two_letters_match_by_contains(spark):
    catalog = spark.createDataFrame(
        [("1", "Al Bo", "x"), ("2", "Bo Cy", "y"), ("3", "Q", "x"), ("4", "Xi", "x")], "player_id string, display_name string, team string")
    refs = spark.createDataFrame([(1, "al"), (2, "bo"), (3, "i"), (4, "zz"), (5, "y"), (6, ""), (7, "q")], "ref_id long, name string")
    resolved, candidates = nm.resolve_references(refs, catalog)
    got = {r.ref_id: (r.status, r.basis, r.n_candidates, r.player_id) for r in resolved.collect()}
    assert got == {
        1: ("resolved", "partial", 1, "1"), 2: ("ambiguous", "partial", 2, None), 3: ("resolved", "partial", 1, "4"),
        4: ("not_found", None, 0, None), 5: ("resolved", "partial", 1, "2"), 6: ("not_found", None, 0, None),
        7: ("resolved", "exact", 1, "3")}
    assert sorted(rows(candidates.select("ref_id", "player_id"))) == [(2, "1"), (2, "2")]


def test_lineup_problems(spark):
    players = spark.createDataFrame([(1, "a", "QB", True), (1, "b", "RB", True), (1, "c", "RB", False), (1, "d", "WR", True)],
                                    "r int, player_id string, position string, usable boolean")
    slots = spark.createDataFrame([(1, "QB", "QB"), (1, "RB1", "RB"), (1, "RB2", "RB"), (1, "FLEX", "FLEX"), (1, "WR", "WR")],
                                  "r int, slot_id string, slot_type string")
    proposed = spark.createDataFrame([(1, "QB", "b"), (1, "RB1", "c"), (1, "RB2", "b"), (1, "FLEX", None), (1, "WR", "z"), (1, "K", None)],
                                     "r int, slot_id string, player_id string")
    got = set(rows(ro.lineup_problems(proposed, players, slots, ["r"]).select("slot_id", "rule")))
    assert got == {
        ("QB", "player used twice"), ("QB", "player not eligible"), ("RB1", "player not eligible"), ("RB2", "player used twice"),
        ("FLEX", "fillable slot left empty"), ("WR", "player not on roster"), ("K", "unknown slot")}


def test_value_buckets_never_fall(spark):
    from seasonframe.common import value_buckets

    rng = random.Random(7)
    values = [0.0, -0.0, 1e-9, -1e-9, 1e300, -1e300, float("inf"), float("-inf"), float("nan")]
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-8, 12) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    coarse, fine = value_buckets(F.col("v"))
    got = df.select("v", coarse.alias("c"), fine.alias("f")).orderBy("v").collect()
    assert [(r.c, r.f) for r in got] == sorted((r.c, r.f) for r in got)
    assert len({r.f for r in got}) > 1900


@pytest.mark.parametrize("desc", [True, False])
def test_ranks_of_ties_signs_and_nulls(spark, desc):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice([None, 0.0, -1.5, 2.25, 1e9, -1e9, round(rng.uniform(-3, 3), 2)])) for _ in range(300)]
    ranked = rk.competition_ranks(spark.createDataFrame(data, "g string, v double"), "v", {"all": [], "group": ["g"]}, desc)
    for g, v, everyone, group in rows(ranked.select("g", "v", "all", "group")):
        ahead = [(x, y or 0) for x, y in data if ((y or 0) > (v or 0) if desc else (y or 0) < (v or 0))]
        assert everyone == 1 + len(ahead) and group == 1 + sum(x == g for x, _ in ahead)


def jobs_started(spark, build):
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out = build()
    return out, set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before


@pytest.mark.parametrize("name", ["W1_competition_rank_overall", "J17_expected_vs_actual", "W4_outperformers", "R2_keyword_search", "R4_rank_fusion", "R11_judgment_contract", "A9_rolling_quota"])
def test_building_starts_no_job(spark, name):
    import __spark_entry__ as entry

    # Reading a table's schema may start a job of its own; the second time it is at hand.
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    schemas = len([t for t in ("orders", "lineitem", "events", "documents", "benchmark", "labels", "customer")])
    _, started = jobs_started(spark, lambda: entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert len(started) <= schemas


def test_keyword_lists_share_one_pass_and_any_split(spark):
    from seasonframe.operators import retrieval as rt

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(50)
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    lists = rt.keyword_lists(docs, "doc_id", {"content": F.col("text")}, queries, "item_id", "text", 5,
                             {"all": None, "de": F.col("lang") == "de"})
    one = rt.keyword_search(docs.coalesce(1).filter("lang = 'de'"), "doc_id", {"content": F.col("text")}, queries, "item_id", "text", 5)
    assert sorted(map(tuple, lists["de"].collect())) == sorted(map(tuple, one.collect()))
    both = lists["all"].unionByName(lists["de"])
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("regexp_extract_all(lower(text") <= 1 + plan.count("ReusedExchange")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_bounded_keyword_search_gives_the_same_rows(spark, k):
    """Frequent and rare words, equal documents, empty and null texts, a null id, queries of unknown words."""
    from seasonframe.operators import retrieval as rt

    rng = random.Random(21)
    words = ["run", "pass", "goal"] * 8 + [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    data = [(i, "run" if i % 3 else None, text(30)) for i in range(400)] + [(1000 + i, "run", "run pass w1 w2") for i in range(9)]
    data += [(2000, None, None), (2001, "", ""), (None, "goal", "run rare1 rare2 w3")]
    docs = spark.createDataFrame(data, "id long, title string, body string")
    asked = [(i, text(12)) for i in range(25)] + [(90, "run pass w1 w2"), (91, "unknown"), (92, ""), (93, None), (None, "rare1 run"), (94, "run run the")]
    queries = spark.createDataFrame(asked, "q long, text string")
    fields = {"title": F.col("title"), "content": F.col("body")}
    for tie in (None, F.col("id") % 5):
        plain, bounded = (f(docs, "id", fields, queries, "q", "text", k, tie) for f in (rt.keyword_search, rt.keyword_search_bounded))
        got = sorted(map(str, bounded.collect()))
        assert got == sorted(map(str, plain.collect())) and len(got) > 20
    assert rt.keyword_search_bounded(docs.limit(0), "id", fields, queries, "q", "text", k).count() == 0
    assert rt.keyword_search_bounded(docs, "id", fields, queries.limit(0), "q", "text", k).count() == 0


def test_bounded_keyword_search_joins_fewer_postings(spark):
    from seasonframe.operators import retrieval as rt

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    queries = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    postings, terms = rt._postings(docs, "doc_id", {"content": F.col("text")}, queries, "item_id", "text", {"all": None}, None)
    words, weights, part = rt._weighted(postings, terms, "item_id", bounds=True)
    split = rt.split_terms(words, weights, part, "doc_id", "item_id", 5)
    joined = {r["needed"]: r["n"] for r in split.groupBy("needed").agg(F.sum("df").alias("n")).collect()}
    assert 0 < joined[True] < sum(joined.values()) / 2


def test_rolling_quota_at_the_edges_of_the_day(spark):
    from seasonframe.operators.aggregates import rolling_quota

    rng = random.Random(11)
    day = 86_400_000_000
    data = [("p" if rng.random() < .8 else None, rng.choice([0, 1, day - 1, day, day + 1, 2 * day, rng.randrange(3 * day)]), rng.choice([0, 1, 3, None])) for _ in range(200)]
    df = spark.createDataFrame(data, "p string, us long, n int").withColumn("ts", F.timestamp_micros("us"))
    for p, us, n, used in rows(rolling_quota(df, "p", "ts", "n", 5).select("p", "us", "n", "used_24h")):
        if p is not None:
            assert used == sum(m or 0 for q, u, m in data if q == p and us - day < u < us)


@pytest.mark.parametrize("kind", ["int", "decimal(6,2)", "decimal(38,18)", "double"])
def test_rolling_quota_of_null_providers_and_fractions(spark, kind):
    from seasonframe.operators.aggregates import rolling_quota

    rng = random.Random(12)
    day = 86_400_000_000
    amounts = [0, 1, 3, None] if kind == "int" else [0, 0.25, 1.5, None]
    data = [(rng.choice(["p", None]), rng.choice([0, 1, day - 1, day, day + 1, rng.randrange(3 * day)]), rng.choice(amounts)) for _ in range(120)]
    data.append((None, None, 1))
    df = spark.createDataFrame([(p, us, None if n is None else str(n)) for p, us, n in data], "p string, us long, n string").select(
        "p", "us", F.timestamp_micros("us").alias("ts"), F.col("n").cast(kind).alias("n"))
    out = rows(rolling_quota(df, "p", "ts", "n", 5).select("p", "us", "used_24h", "exhausted"))
    assert len(out) == len(data) and any(p is None and used for p, _, used, _ in out)
    for p, us, used, exhausted in out:
        want = 0 if us is None else sum(m or 0 for q, u, m in data if u is not None and q == p and us - day < u < us)
        assert float(used) == want and exhausted == (want >= 5)




def test_pregame_snapshot_by_values_not_names(spark):
    snaps = spark.createDataFrame(
        [("a", "2024-01-01", None, "x"), ("a", "2024-01-03", None, "y"), ("a", "2024-01-09", None, "late"), ("b", "2024-01-02", 7, "given"), ("b", "2024-01-02", 7, "given")],
        "p string, d string, week int, v string").withColumn("d", F.to_date("d"))
    games = spark.createDataFrame([("a", "2024-01-04", 1), ("b", "2024-01-05", 1)], "p string, d string, week int").select(
        "p", F.to_date("d").alias("at"), "week")
    assert sorted(rows(jn.pregame_snapshot(snaps, games, "p", "d", "at", ["week"]).select("p", "week", "v"))) == [("a", 1, "y"), ("b", 7, "given")]
    bare = snaps.filter("week IS NULL").drop("week")
    assert rows(jn.pregame_snapshot(bare, games, "p", "d", "at", ["week"]).select("p", "week", "v")) == [("a", 1, "y")]


def test_two_games_in_a_week_fail(spark):
    games = spark.createDataFrame([(1, 1, "A", "B"), (2, 1, "C", "D"), (3, 2, "A", "C")], "g int, week int, home string, away string")
    assert jn.both_sides(games, "home", "away", period=["week"]).count() == 6
    twice = games.union(spark.createDataFrame([(4, 1, "B", "E")], games.schema))
    with pytest.raises(Exception, match="more than one game"):
        jn.both_sides(twice, "home", "away", period=["week"]).collect()


def test_lineups_of_every_slot_set_against_search(spark):
    rng = random.Random(5)
    positions = ["QB", "RB", "WR", "TE", "LB", "DB"]
    people, slot_rows = [], []
    for r in range(40):
        for k in range(rng.randrange(1, 7)):
            people.append((r, f"{r}-{k}", rng.choice(positions), float(rng.randrange(1, 30)), True, None))
        for kind in [*positions, "REC_FLEX", "WRRB_FLEX", "FLEX", "SUPER_FLEX", "IDP_FLEX"]:
            if rng.random() < 0.3:
                slot_rows.append((r, kind, rng.randrange(1, 3)))
    players = spark.createDataFrame(people, "r int, player_id string, position string, points double, usable boolean, locked_slot string")
    slots = spark.createDataFrame(slot_rows, "r int, slot_type string, n_slots int")
    lineup, apart = ro.best_lineup(players, slots, ["r"])
    both = {r for r, k, _ in slot_rows if k == "REC_FLEX"} & {r for r, k, _ in slot_rows if k == "WRRB_FLEX"}
    assert {x["r"] for x in apart.collect()} == both
    got = {}
    for x in lineup.collect():
        n, total = got.get(x["r"], (0, 0.0))
        assert x["slot_type"] == x["position"] or x["position"] in ro.FLEX_ELIGIBILITY[x["slot_type"]]
        got[x["r"]] = (n + 1, total + x["points"])
    for r in range(40):
        if r in both:
            assert r not in got
            continue
        open_slots = [k for q, k, n in slot_rows if q == r for _ in range(n)]
        mine = [(p, v) for q, _, p, v, _, _ in people if q == r]

        def best(i, free):
            if i == len(mine):
                return (0, 0.0)
            out = best(i + 1, free)
            for k in set(free):
                if k == mine[i][0] or mine[i][0] in ro.FLEX_ELIGIBILITY.get(k, ()):
                    rest = list(free)
                    rest.remove(k)
                    n, v = best(i + 1, tuple(rest))
                    out = max(out, (n + 1, v + mine[i][1]))
            return out

        assert got.get(r, (0, 0.0)) == best(0, tuple(open_slots))


def test_relocated_teams_and_folded_names(spark):
    from seasonframe.functions.scalars import name_key
    from seasonframe.plans.presets import FRANCHISE_RELOCATIONS

    teams = spark.createDataFrame([("OAK", "Oakland Raiders", "Raiders"), ("LV", "Las Vegas Raiders", "Raiders"), ("SD", "San Diego Chargers", "Chargers")],
                                  "code string, name string, nickname string")
    refs = spark.createDataFrame([(1, "Raiders"), (2, "Oakland Raiders"), (3, "oak"), (4, "Chargers")], "ref_id int, text string")
    now = {x["ref_id"]: x["code"] for x in nm.resolve_alias(refs, teams, relocations=FRANCHISE_RELOCATIONS)[0].collect()}
    assert now == {1: "LV", 2: "LV", 3: "LV", 4: "LAC"}
    then = {x["ref_id"]: (x["status"], x["code"]) for x in nm.resolve_alias(refs, teams, relocations=FRANCHISE_RELOCATIONS, season=2010)[0].collect()}
    assert then[1] == ("ambiguous", None) and then[2] == ("resolved", "OAK") and then[4] == ("resolved", "SD")
    names = spark.createDataFrame([("Luka Dončić",), ("Žan Ó Sé",), ("été",)], "n string")
    assert rows(names.select(name_key(F.col("n"), "ascii"))) == [("luka doncic",), ("zan o se",), ("ete",)]


def test_upsert_with_repeats(spark):
    from seasonframe.sources.tables import upsert

    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, v string")
    with pytest.raises(Exception, match="upsert"):
        upsert(old, new, ["k"]).collect()
    assert sorted(rows(upsert(old, new, ["k"], [F.col("v")]))) == [(1, "b"), (2, "old"), (3, "c")]


def test_state_changes_of_equal_times_do_not_depend_on_row_order(spark):
    data = [("a", 1, "x"), ("a", 1, "z"), ("a", 1, "y"), ("a", 2, "z")]
    seen = set()
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "e string, t int, s string").withColumn("at", F.timestamp_seconds("t"))
        seen.add(tuple(sorted(rows(inc.state_changes(df, ["e"], "at", ["s"]).select("s", "previous_s")))))
    assert seen == {(("y", "x"), ("z", "y"))}
