"""Profiles kept by generations: batches in any order give the templates of one pass, and repeated batches count once."""

import random

from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.streaming import ingest, profiles
from tests.test_functions import EDGE
from tests.test_store_and_window import batch

FLOW = "tenant string, flow_id string, host string, method string, path string, query string, status int, providers array<string>, cookie_names array<string>, last_us long, response_bytes long"


def flows(spark):
    rows = []
    for k in range(90):
        rows.append(("t", f"u{k}", "H.example:443", "get", f"/u/{k}/view", f"a={k % 3}&b=x{k}", 200 + (k % 2), ["nginx"], [f"c{k % 5}"], k, k))
    rows += [("t", f"s{k}", "h.example", "GET", "/u/search/view", "q=1", 200, ["cloudflare"], [], 100 + k, None) for k in range(7)]
    rows += [("t", f"h{k}", "h.example", "GET", "/health", None, None, [], None, 200 + k, None) for k in range(20)]
    rows += [("v", f"o{k}", "h.example", "", "/u/1/view", None, 404, [], ["z"], 300 + k, 5) for k in range(3)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, FLOW)


def content(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_batches_in_any_order_give_the_templates_of_one_pass(spark, tmp_path):
    rows, roots = flows(spark), [str(tmp_path / n) for n in ("one", "many")]
    profiles.absorb(spark, table(spark, rows), roots[0], 0)
    random.Random(4).shuffle(rows)
    parts = [rows[:50], rows[50:110], rows[110:]]
    for k, part in enumerate(parts):
        profiles.absorb(spark, table(spark, part), roots[1], k)
        if k == 1:
            profiles.absorb(spark, table(spark, part), roots[1], k)  # the same batch again
    one, many = (profiles.stored(spark, r) for r in roots)
    for k in profiles.TABLES:
        assert content(one[k]) == content(many[k]), k
    found = {(r["tenant"], r["method"], r["template"]): r for r in one["endpoints"].collect()}
    assert {k: r["observations"] for k, r in found.items()} == {("t", "GET", "/u/{int}/view"): 90, ("t", "GET", "/u/search/view"): 7, ("t", "GET", "/health"): 20, ("v", "UNKNOWN", "/u/1/view"): 3}
    folded = found["t", "GET", "/u/{int}/view"]
    assert (folded["first_us"], folded["last_us"], folded["max_response_bytes"], folded["providers"]) == (0, 89, 89, ["nginx"])
    assert {(r["status"], r["n"]) for r in one["statuses"].where("template = '/u/{int}/view'").collect()} == {(200, 45), (201, 45)}
    assert [r["cookie_names"] for r in one["cookies"].where("template = '/u/{int}/view'").collect()] == [["c0", "c1", "c2", "c3", "c4"]]
    params = {r["name"]: r for r in one["params"].where("template = '/u/{int}/view'").collect()}
    assert (params["a"]["inferred_type"], params["a"]["present_count"], params["a"]["enum_values"]) == ("int", 90, ["0", "1", "2"]) and params["b"]["enum_overflowed"]


def test_a_collapse_retires_its_literals_and_holds(spark, tmp_path):
    root = str(tmp_path)
    at = lambda k, paths: profiles.absorb(spark, table(spark, [("t", f"{k}-{i}", "h", "GET", p, None, 200, [], [], i, None) for i, p in enumerate(paths)]), root, k)
    names = lambda df: sorted(r["template"] for r in df.collect())
    at(0, [f"/u/{k}" for k in range(40)] + ["/u/new"])
    assert len(names(profiles.profiles(spark, root))) == 41
    at(1, [f"/u/{k}" for k in range(30, 70)])
    assert names(profiles.profiles(spark, root)) == ["/u/new", "/u/{int}"] and names(profiles.retired(spark, root)) == sorted(f"/u/{k}" for k in range(40))
    at(2, ["/u/999", "/u/old", "/u/{int}"])  # one value is enough where a position has collapsed
    assert {r["template"]: r["observations"] for r in profiles.profiles(spark, root).collect()} == {"/u/new": 1, "/u/old": 1, "/u/{int}": 82}
    profiles.compact(spark, root)
    assert profiles.retired(spark, root).count() == 0 and profiles.profiles(spark, root).where("endpoint_id like 'ep_%'").count() == 3


def test_settings_of_tenants_decide_what_is_profiled(spark):
    configs = spark.createDataFrame([("t", '{"enabled": true, "hosts": ["*.example"], "excluded_paths": ["/health"]}'), ("v", "{broken")], "tenant string, config string")
    seen = profiles.observations(table(spark, flows(spark)), configs)
    assert {(r["tenant"], r["path"].split("/")[1]) for r in seen.collect()} == {("t", "u")}
    assert seen.count() == 97


def test_learned_positions(spark):
    t = spark.createDataFrame([("h", "/a/{int}/{hex}"), ("h", "/a/b"), ("g", "/{var}")], "host string, template string")
    found = profile.learned_positions(t, ["host"]).select("host", "_prefix", "_known")
    assert sorted(tuple(r) for r in found.collect()) == [("g", "/", "var"), ("h", "/a", "int"), ("h", "/a/{int}", "hex")]


def test_profiles_follow_the_flow_log(spark, tmp_path):
    root = str(tmp_path)
    line = lambda k: ("t", "cloudflare", (EDGE % (f"a{k}", 200, "allow", f"d{k}")))
    ingest.absorb(spark, batch(spark, line(1), line(2)), root, now_us=1_700_000_000_000_000)
    profiles.run(spark, profiles.closed_flows(spark, root), root, str(tmp_path / "c")).awaitTermination()
    ingest.absorb(spark, batch(spark, line(2), line(3), ("t", "nginx", '{"time_iso8601":"2024-01-01T00:00:00+00:00","cf_ray":"a1-FRA","status":"200","request_uri":"/a","host":"h"}')), root, now_us=1_700_000_000_000_001)
    profiles.run(spark, profiles.closed_flows(spark, root), root, str(tmp_path / "c")).awaitTermination()
    # the first flow is amended and the second comes again: each counts once
    assert profiles.profiles(spark, root).agg(F.sum("observations")).first()[0] == 3
