"""Golden cases and differential tests of the operators."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strataloom import catalog
from strataloom.functions import expr
from strataloom.operators import graph, lifecycle, metrics, overlay, records, resolution, search
from strataloom.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def now(text):
    return F.lit(text).cast("timestamp")


def test_token_estimate_and_quantising(spark):
    assert value(spark, expr.estimated_tokens(F.lit(""))) == 1
    assert value(spark, expr.estimated_tokens(F.lit("abcd"))) == 2
    assert value(spark, expr.quantised(F.lit(-0.0000005))) == 0
    assert value(spark, expr.identifier_tokens(F.lit("fooBar_baz.Qux/x"))) == "foo bar baz qux x"


def test_utility_cases(spark):
    at = now("2024-01-01")

    def score(importance, assertion, kind, validation, anchor, accesses, basis="2024-01-01"):
        return value(spark, expr.utility(F.lit(importance), F.lit(assertion), F.lit(kind), F.lit(validation), F.lit(anchor), F.lit(accesses), now(basis), at))

    assert score(3, "observed", "fact", "unlinked", False, 0) == 520
    assert score(5, "verified", "decision", "valid", True, 20) == 1000
    assert score(5, "rejected", "fact", "valid", False, 0) == 0
    assert score(5, "observed", "fact", "contradicted", False, 0) == 0
    assert score(3, "observed", "episode", "unlinked", False, 0) == 460
    assert score(3, "observed", "fact", "unlinked", False, 0, "2023-10-30") == 480


def test_utility_ages_by_full_blocks_of_30_days(spark):
    def score(basis, at):
        return value(spark, expr.utility(F.lit(3), F.lit("observed"), F.lit("fact"), F.lit("unlinked"), F.lit(False), F.lit(0), now(basis), now(at)))

    assert score("2024-01-05 00:00:00", "2024-09-01") == 520 - 8 * 20
    assert score("2024-01-05 00:00:00.000001", "2024-09-01") == 520 - 7 * 20
    assert score("2024-01-05 00:00:00.316910", "2024-09-01") == 520 - 7 * 20
    assert score("2024-01-05 00:00:01", "2024-09-01") == 520 - 7 * 20
    assert score("2024-01-05 00:00:00.5", "2024-09-01 00:00:00.5") == 520 - 8 * 20
    assert score("2024-01-04 23:59:59.999999", "2024-09-01") == 520 - 8 * 20
    assert score("2024-09-01 00:00:00.5", "2024-09-01") == 520


def test_utility_score_matches_sql_at_the_end_of_a_block(spark, tmp_path):
    con = duckdb.connect()
    con.execute("""create table events as select row_number() over () - 100 as event_id, timestamp '2024-09-01' - to_days(30 * k::int) + to_microseconds(d) as ts, u as user_id, e as event_type
        from range(-1, 10) b(k), (values (0), (1), (-1), (316910), (999999), (-999999), (1000000)) x(d), (values (-13), (0), (1), (7), (13), (null)) y(u), (values ('purchase'), ('click'), ('error'), ('view'), (null)) z(e)
        union all select 0, null, 4, 'click'""")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = con.execute(catalog.ORACLE_SQL["utility_score"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["utility_score"](spark, str(tmp_path)).collect())) == sorted(want)


def test_gate_cases(spark):
    def why(expires=None, start="2023-01-01", end=None, assertion="observed", validation="valid", maintenance="clean", state="active"):
        none = F.lit(None).cast("timestamp")
        c = expr.ineligible_reason(F.lit(state), now(expires) if expires else none, now(start), now(end) if end else none, F.lit(assertion), F.lit(validation), F.lit(maintenance), now("2024-01-01"))
        return value(spark, c)

    assert why() is None and why(start="2024-01-01") is None
    assert why(expires="2024-01-01") == "LIFECYCLE_EXPIRED" and why(end="2024-01-01") == "VALIDITY_ENDED"
    assert why(start="2024-01-02") == "NOT_YET_VALID" and why(state="archived") == "LIFECYCLE_INACTIVE"
    assert why(validation="stale") == "VALIDATION_STALE" and why(maintenance="review_required") == "MAINTENANCE_REVIEW_REQUIRED"


def test_intervals_paths_and_statements(spark):
    t = lambda n: now(f"2024-01-0{n}")
    assert not value(spark, expr.overlaps(t(1), t(2), t(2), t(3)))
    paths = {"/a//b/?x=1": "/a/b", "/u/:id": None, "//h/x": None, "https://h/x": None, "/": "/", "": None, "/a/": "/a"}
    assert {p: value(spark, expr.static_path(F.lit(p))) for p in paths} == paths
    sql = lambda s: value(spark, expr.classified_sql(F.lit(s)))
    assert tuple(sql("SELECT a FROM S.T")) == ("reader", "read", "s.t")
    assert tuple(sql("DELETE FROM t")) == ("writer", "delete", "t")
    assert sql("select 1 from a; select 2 from b") is None


def test_redundancy(spark):
    like = lambda a, b: value(spark, expr.text_redundancy(expr.redundancy_tokens(F.lit(a)), expr.redundancy_tokens(F.lit(b))))
    assert like("query: fooBar", "foo bar") == 1.0 and like("", "") == 0.0
    rng = random.Random(1)
    for _ in range(15):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        assert like(" ".join(a), " ".join(b)) == pytest.approx(search.text_likeness(a, b))


def test_rrf_and_diverse_selection(spark):
    sources = spark.createDataFrame([("q", "g", "a", 1.0), ("q", "g", "b", 1.0)], "query_id string, grp string, source string, weight double")
    ranked = spark.createDataFrame([("q", "g", "a", 1, 1), ("q", "g", "a", 2, 2)], "query_id string, grp string, source string, id long, rank int")
    assert {r.id: r.relevance for r in search.rrf(ranked, sources.filter("source = 'a'")).collect()} == {1: 1.0, 2: 0.983871}
    assert {r.id: r.relevance for r in search.rrf(ranked, sources).collect()}[1] == 0.5
    got = search.select_diverse([1, 2, 3], [1.0, 0.9, 0.8], [[1, 0], [1, 0], [0, 1]], [[], [], []], 3)
    assert [i for i, _ in got] == [0, 2, 1]
    same = "a b c d e f".split()
    assert [i for i, _ in search.select_diverse([1, 2], [1.0, 0.9], [None, None], [same, same], 2)] == [0]
    assert [i for i, _ in search.select_diverse([1, 2], [1.0, 0.9], [None, None], [["x"], ["y"]], 2, pinned=[2])] == [1, 0]


def slow_trace(edges, start, direction, depth):
    seen, frontier, out = {start}, [start], []
    for d in range(1, depth + 1):
        fresh = []
        for n in frontier:
            for s, t, k, st in edges:
                for at, to in ((s, t),) * (direction in ("out", "both")) + ((t, s),) * (direction == "in" or direction == "both" and s != t):
                    if at == n:
                        out.append((d, s, t, k))
                        if st != "rejected" and to not in seen:
                            seen.add(to)
                            fresh.append(to)
        frontier = fresh
    return sorted(out)


def test_trace_matches_a_queue(spark):
    rng = random.Random(2)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("AB"), rng.choice(["resolved", "candidate", "rejected"])) for _ in range(30)]
    rows = sorted({(a, b, k): (a, b, k, s) for a, b, k, s in rows}.values())
    df = spark.createDataFrame(rows, "src string, dst string, kind string, status string")
    start = spark.createDataFrame([("n1",)], "start string")
    for direction in ("in", "out", "both"):
        got = sorted((r.depth, r.src, r.dst, r.kind) for r in graph.trace(df, start, direction, 3).collect())
        assert got == slow_trace(rows, "n1", direction, 3)
    with pytest.raises(ValueError):
        graph.trace(df, start, "both", 6)


def test_impact_prefers_confirmed_paths(spark):
    rows = [("b", "a", "resolved", 0.95), ("c", "b", "resolved", 0.9), ("c", "a", "candidate", 0.99), ("d", "c", "resolved", 0.92), ("e", "a", "rejected", 1.0)]
    df = spark.createDataFrame(rows, "src string, dst string, status string, confidence double")
    got = {r.node: (r.min_depth, r.confidence, r.confirmed) for r in graph.impact(df, spark.createDataFrame([("a",)], "start string")).collect()}
    # d is reached from c at the state that c has at depth 1
    assert got == {"b": (1, 0.95, True), "c": (1, 0.99, True), "d": (2, 0.92, False)}


def test_overlay_ties_go_to_the_overlay(spark):
    schema = "src string, dst string, kind string, status string, confidence double"
    base = spark.createDataFrame([("a", "b", "K", "candidate", 0.5), ("a", "c", "K", "resolved", 0.9), ("a", "d", "K", "candidate", 0.5)], schema)
    over = spark.createDataFrame([("a", "b", "K", "candidate", 0.7), ("a", "c", "K", "rejected", 0.99), ("x", "y", "K", "resolved", 1.0)], schema)
    got = {(r.src, r.dst): (r.status, r.confidence, r.origin) for r in overlay.effective_edges(base, over).collect()}
    assert got == {("a", "b"): ("candidate", 0.7, "overlay"), ("a", "c"): ("resolved", 0.9, "base"), ("a", "d"): ("candidate", 0.5, "base"), ("x", "y"): ("resolved", 1.0, "overlay")}


def test_similar_pairs_match_all_pairs(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        base = rng.choice(texts) if texts and rng.random() < 0.7 else " ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.choice([3, 4, 90, 200])))
        words = base.split()
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = "zz" + str(rng.randrange(5))
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "id long, k long, text string")
    got = {(r.left, r.right) for r in records.similar_pairs(df, ["k"]).collect()}
    want = {(i, j) for j in range(60) for i in range(j) if i % 2 == j % 2 and 0.85 <= search.text_likeness(texts[i].split(), texts[j].split()) < 1}
    assert got == want and want


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 2, 1), ("q", 1, 2)], "query_id string, id long, rank int")
    gold = spark.createDataFrame([("q", 1, 3)], "query_id string, id long, grade int")
    r = metrics.ranking_scores(ranked, gold, 2).first()
    assert (r.recall, r.rr, r.ndcg) == (1.0, 0.5, 0.63093)
    assert value(spark, expr.nearest_rank(F.array(*map(F.lit, range(1, 21))), 0.95)) == 20
    assert metrics.gates(0.5, 0.5)[0] == 0.8 and metrics.gates(0.8, 0.95) == (0.9, 1.0)


def test_scan_and_changes(spark, tmp_path):
    for name in ("a.py", "lib/b.ts", "node_modules/c.js", ".env.py", "x.min.js", "keep/secret.py", "big.go", "skip/d.py"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x" * (100 if name == "big.go" else 3))
    got = {r.path: r.language for r in files.scan(spark, str(tmp_path), ["skip/"], most_bytes=50).collect()}
    assert got == {"a.py": "python", "lib/b.ts": "typescript"}
    one = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    two = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, hash string")
    assert {tuple(r) for r in files.changes(one, two).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "added")}


def test_stream_equals_batch(spark, tmp_path):
    from strataloom.plans.records import events_as_log
    from strataloom.streaming import events as ev

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ev.read_events(spark, str(tmp_path / "in"), table.schema, 1)
    query = ev.fold_stream(events_as_log(stream)).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.sql("select * from folded").collect():
        if r.record not in last or r.access_count >= last[r.record].access_count:
            last[r.record] = r
    want = {r.record: (r.access_count, r.last_access) for r in records.folded(events_as_log(table)).collect()}
    assert {k: (r.access_count, r.last_access) for k, r in last.items()} == want


def test_claims_hold_for_their_lease(spark):
    rows = [("j", "a", 0), ("j", "b", 10), ("j", "a", 20), ("j", "b", 45), ("j", "b", 50), ("j", "a", 60), ("k", "b", 5)]
    df = spark.createDataFrame(rows, "job string, worker string, s int").selectExpr("job", "worker", "timestamp_seconds(s) as at")
    got = sorted((r.job, r.worker, int(r.at.timestamp())) for r in lifecycle.granted_claims(df).collect())
    assert [(j, w, s % 100) for j, w, s in got] == [("j", "a", 0), ("j", "a", 20), ("j", "b", 50), ("k", "b", 5)]


def test_health_of_components(spark):
    logs = {"new": "y", "good": "nyy", "back": "yny", "bad": "ynn", "dead": "nnn"}
    rows = [(c, x == "y", i, i) for c, log in logs.items() for i, x in enumerate(log)]
    df = spark.createDataFrame(rows, "component string, ok boolean, at int, id int")
    assert {r.component: r.health for r in lifecycle.health(df).collect()} == {"new": "healthy", "good": "healthy", "back": "recovered", "bad": "degraded", "dead": "failed"}


def test_aliases_of_circles_and_long_chains(spark):
    names = spark.createDataFrame([(n,) for n in "abcxyz"] + [(f"n{i}",) for i in range(12)], "name string")
    links = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")] + [(f"n{i}", f"n{i + 1}") for i in range(11)]
    got = {r.name: r.target for r in resolution.resolve_aliases(names, spark.createDataFrame(links, "name string, target string")).collect()}
    assert [got[n] for n in "abcxyz"] == ["c", "c", "c", None, None, "z"]
    assert got["n2"] is None and got["n3"] == "n11" and got["n11"] == "n11"


def test_binary_scores_match_a_walk_down_the_ranking(spark):
    rng = random.Random(5)
    ranked, gold, want = [], [], {}
    for q in range(12):
        targets = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 5))})
        items = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(8)]
        left, dcg = list(targets), 0.0
        for i, item in enumerate(items[:5]):
            hit = next((x for x in left if x in item), None)
            if hit:
                left.remove(hit)
                dcg += 1 / math.log2(i + 2)
        best = sum(1 / math.log2(i + 2) for i in range(min(len(targets), 5)))
        want[str(q)] = (round(sum(any(x in i for i in items[:5]) for x in targets) / len(targets), 5), round(dcg / best, 5))
        ranked += [(str(q), item, i + 1) for i, item in enumerate(items)]
        gold += [(str(q), x) for x in targets]
    got = metrics.binary_scores(spark.createDataFrame(ranked, "query_id string, item string, rank int"), spark.createDataFrame(gold, "query_id string, target string"), 5)
    assert {r.query_id: (round(r.recall, 5), round(r.ndcg, 5)) for r in got.collect()} == want


def test_duplicate_waste_matches_all_earlier_texts(spark):
    rng = random.Random(8)
    texts = [None, "", "", "one two", "One  two!"]
    for _ in range(60):
        words = (rng.choice(texts[5:]) if len(texts) > 5 and rng.random() < 0.7 else " ".join(rng.choice("abcdef") + str(rng.randrange(40)) for _ in range(rng.choice([4, 60, 120])))).split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = "z" + str(rng.randrange(5))
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "id long, k long, text string")
    toks = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)} for t in toks]
    want = {k: [0, 0] for k in range(3)}
    for i, mine in enumerate(toks):
        want[i % 3][0] += len(mine)
        near = next((j for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), None)
        want[i % 3][1] += 0 if near is None else sum(t in toks[near] for t in mine)
    got = {r.k: [r.tokens, r.wasted] for r in records.duplicate_waste(df, ["k"]).collect()}
    assert got == want and all(w for _, w in want.values())
    assert records.duplicate_waste(df.limit(0), ["k"]).count() == 0


def test_imports_resolve_in_order(spark):
    asked = spark.createDataFrame([("a.b::m",), ("x.decl",), ("x.twice",), ("os.Path",)], "specifier string")
    modules = spark.createDataFrame([("m", 1), ("twice", 2), ("twice", 3)], "name string, id long")
    declared = spark.createDataFrame([("decl", 7), ("m", 8)], "name string, id long")
    got = {r.specifier: (r.target, r.how) for r in resolution.resolve_imports(asked, modules, declared, "py").collect()}
    assert got["a.b::m"] == ("1", "import") and got["x.decl"] == ("7", "exact")
    assert got["x.twice"][1] == got["os.Path"][1] == "external" and got["os.Path"][0] == hashlib.sha256(b"external:py:os.path").hexdigest()


def test_revision_moves_only_on_change(spark):
    prior = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", 1, "x")], "provider string, id long, v string")
    want = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, None), ("c", 1, None), ("d", 1, "x")], "provider string, id long, v string")
    now = spark.createDataFrame([(p, 4) for p in "abcde"], "provider string, revision long")
    got = {r.provider: r.revision for r in overlay.next_revisions(now, prior, want).collect()}
    assert got == {"a": 4, "b": 4, "c": 5, "d": 5, "e": 4}
