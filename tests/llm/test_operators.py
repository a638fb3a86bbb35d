"""Every operator against a brute-force version, on the smallest tables and on rows chosen to be awkward."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, minhash_dedup, pseudonyms, quality_rules, queries, quote_linking, slot_sharding, source_mixing, suffix_dedup, token_counts, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
LONG = "the quick brown fox jumps over the lazy dog and runs away from 12 hungry wolves, " * 40
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, number string"


def docs(spark):
    """Null texts, empty and blank ones, repeated rows, a repeated id, null ids, a very long text, clashing column names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one two", "en", "a"), (5, "One two", "en", "b"), (6, base, "en", "b"), (7, base + " phi", "en", "b"), (7, base + " phi", "en", "b"),
        (8, base.replace("beta", "BETA"), "de", "b"), (None, base, "en", None), (None, None, None, None), (9, LONG, "en", "b"), (10, LONG * 60, "en", "c"), (11, "é ß 漢字 <|endoftext|> it's 3rd İstanbul Σίσυφος \u0085 x", "xx", "c"), (12, "x\ny\nx\n\nx", "en", "c"), (6, "another text under a used id", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "clash", "clash", "clash") for i, t, la, s in rows], DOCS)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sets_of(table):
    out = []
    for i, text in table:
        w = WORD.findall((text or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    return out


def components(table):
    sets = sets_of(table)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i, i == (least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_near_duplicates(spark, sf, which):
    df = docs(spark) if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(minhash_dedup.near_duplicates(df)) == sorted(components(pairs(df)), key=repr)


def test_drop_near_duplicates_keeps_one_of_each_group(spark, sf):
    df = docs(spark)
    left = minhash_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    kept = {r for r in components(pairs(df)) if r[3]}
    worded = sorted(r[0] is not None and r[0] or -1 for r in kept if r[1])
    assert sorted(i or -1 for i, t in pairs(left) if WORD.search(t or "")) == worded
    assert len([1 for _, t in pairs(left) if not WORD.search(t or "")]) == len([1 for _, t in pairs(df) if not WORD.search(t or "")])
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(i for i, _ in pairs(minhash_dedup.drop_near_duplicates(table))) == sorted(r[0] for r in components(pairs(table)) if r[3])


def test_copies_of_one_id_and_of_none_make_one_set(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words))] * 5000 + [(3, " ".join(words[:38]))] * 5000 + [(9, " ".join(words[:30]))] + [(4, "a b c d e f")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    every = minhash_dedup.sketch_table(table)
    keys = every.groupBy("row").count()
    wanted = every.groupBy("fp").agg(F.min("row").alias("row"))
    sets = minhash_dedup.full_sets(table, wanted, keys.where("count > 1").select("row")).collect()
    assert sorted(len(r["set"]) // 8 for r in sets) == [2, 26, 34, 36]
    out = Counter(tuple(r) for r in minhash_dedup.near_duplicates(table).collect())
    assert out == {(None, 36, 3, False): 5000, (3, 34, 3, True): 5000, (9, 26, 3, False): 1, (4, 2, 4, True): 2}


def test_crowded_band_keys_are_split_without_a_change(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = spark.createDataFrame([(k, bytes([i]), 8) for k, n in ((5, 90), (-7, 1), (8, 3)) for i in range(n)], "key long, fp binary, shingles long")
    whole = rows_of(minhash_dedup.with_pivots(keyed))
    assert Counter(r[0] for r in whole) == {5: 90, 8: 3} and {r[3] for r in whole} == {b"\0"}
    monkeypatch.setattr(minhash_dedup, "CROWD", 2)
    monkeypatch.setattr(minhash_dedup, "CROWDED", 0)
    assert {r["lots"] for r in minhash_dedup.lots(keyed)[0].select("key", "lots").distinct().collect()} == {45, 1, 2}
    assert rows_of(minhash_dedup.with_pivots(keyed)) == whole
    assert rows_of(minhash_dedup.near_duplicates(table)) == sorted(components(pairs(table)), key=repr)


def contamination(table, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k : k + 10])] |= {str(item)} - {"None"}  # an item without id has windows and no name
    sizes, out = {len(k) for k in windows}, []
    for i, text in table:
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (s := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= s
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_contamination(spark, sf, which):
    if which == "awkward":
        items = spark.createDataFrame([(1, "ONE two"), (2, None), (3, ""), (4, LONG[:200]), (4, LONG[:200]), (None, "alpha beta"), (10, "é"), (11, "x y x x")], "item_id long, text string")
        df = docs(spark)
    else:
        df, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    want = contamination(pairs(df), [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(decontamination.contamination_report(df, items)) == want
    clean = decontamination.decontaminate(df, items)
    assert clean.columns == df.columns and clean.count() == sum(not r[-1] for r in want)


def test_pseudonyms_keep_form_and_link_values(spark):
    key = "k"
    values = [("date", f"{y}-0{m}-1{d}") for y in (1999, 2024) for m in range(1, 8) for d in range(9)] + [("ip", f"10.{a}.3.{b}") for a in range(9) for b in range(9)] + [("phone", f"+1 (555) 234-{n:04d}") for n in range(60)] + [("ssn", f"665-0{n}-000{m}") for n in range(1, 9) for m in range(1, 9)]

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    values += [("card", str(n)) for n in range(4111111111111000, 4111111111113000) if luhn(str(n))]
    df = spark.createDataFrame(values, "kind string, v string")
    out = df.select("kind", "v", pseudonyms.pseudonym(F.col("v"), F.col("kind"), key).alias("p"), pseudonyms.pseudonym(F.col("v"), F.col("kind"), "other").alias("q")).withColumn("again", pseudonyms.kind_of(F.col("p"))).collect()
    assert all(r["again"] == r["kind"] and len(r["p"]) >= len(r["v"]) - 6 for r in out)
    assert len({(r["kind"], r["p"]) for r in out}) == len(values) and sum(r["p"] == r["q"] for r in out) < 3
    assert all(re.sub("[0-9]", "0", r["p"]) == re.sub("[0-9]", "0", r["v"]) for r in out if r["kind"] != "ip")
    texts = spark.createDataFrame([(1, "card 4111 1111 1111 1111, bad 4111111111111112", "x"), (2, "card 4111-1111-1111-1111 on 2023-02-29 or 2024-02-29", "x"), (3, None, "x"), (4, "", "x"), (1, "no values", "x")], "doc_id long, text string, _fp string")
    got = {(r["doc_id"], r["n_card"], r["n_date"]): r["text"] for r in pseudonyms.pseudonym_report(texts).collect()}
    digits = [re.sub("[^0-9]", "", re.search("[0-9][0-9 -]{18}", got[k]).group()) for k in ((1, 1, 0), (2, 1, 1))]
    assert digits[0] == digits[1] and luhn(digits[0]) and "4111111111111112" in got[(1, 1, 0)] and "2023-02-29" in got[(2, 1, 1)]
    assert got[(3, 0, 0)] is None and got[(4, 0, 0)] == ""


def feistel(a, b, moduli, key, kind):
    """The network by its definition."""
    for i in range(10):
        h = int(hashlib.sha256(f"{key}|{kind}|{i}|{a if i % 2 else b}|{key}".encode()).hexdigest()[:15], 16)
        a, b = (a, (b + h) % moduli[1]) if i % 2 else ((a + h) % moduli[0], b)
    return a, b


def luhn_digit(payload):
    return str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload))) % 10)


def iban_check(country, account):
    return f"{98 - int(account + ''.join(str(ord(c) - 55) for c in country) + '00') % 97:02d}"


def pseudonym_by_definition(v, kind, key):
    d = re.sub("[^0-9]", "", v)
    if kind == "date":
        day = datetime.date.fromisoformat(v) if v[4] == "-" else datetime.datetime.strptime(v, "%d/%m/%Y").date()
        a, b = feistel(*divmod((day - datetime.date(1800, 1, 1)).days, 773), (189, 773), key, kind)
        out = datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)
        return out.isoformat() if v[4] == "-" else out.strftime("%d/%m/%Y")
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, kind)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ssn":
        area = int(d[:3])
        a, b = feistel(area - 1 - (area > 666), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, (898, 99 * 9999), key, kind)
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "phone" and len(d) == 7:
        a, b = feistel(int(d[:3]) - 200, int(d[3:]), (800, 10_000), key, "local")
        new = f"{a + 200:03d}{b:04d}"
    elif kind == "phone":
        a, b = feistel(int(d[-10:-7]) - 200, int(d[-7:]) - 2_000_000, (800, 8_000_000), key, kind)
        new = d[:-10] + f"{a + 200:03d}{b + 2_000_000:07d}"
    else:
        body = d[:-1] if kind == "card" else d[2:]
        left = len(body) // 2
        a, b = feistel(int(body[:left]), int(body[left:]), (10**left, 10 ** (len(body) - left)), key, kind)
        body = str(a).zfill(left) + str(b).zfill(len(body) - left)
        new = body + luhn_digit(body) if kind == "card" else iban_check(v[:2], body) + body
    digits = iter(new)
    return re.sub("[0-9]", lambda _: next(digits), v)


def test_pseudonyms_against_the_definition(spark):
    pick = random.Random(7)
    number = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    values = [("date", str(datetime.date(1800, 1, 1) + datetime.timedelta(pick.randrange(189 * 773)))) for _ in range(30)] + [("date", "29/02/2024"), ("date", "1800-01-01"), ("date", "2199-12-31")]
    values += [("ip", ".".join(str(pick.randrange(256)) for _ in range(4))) for _ in range(20)] + [("ip", "0.0.0.0"), ("ip", "255.255.255.255")]
    values += [("ssn", f"{a}-{pick.randrange(1, 100):02d}-{pick.randrange(1, 10000):04d}") for a in ("001", "665", "667", "899")]
    values += [("phone", f) for f in ("555-3824", "212 555-0199", "(212) 555-0199", "+1 (212) 555-0199", "1-212-555-0199", "999.9999")]
    values += [("card", p + luhn_digit(p)) for p in (number(n) for n in range(12, 19))] + [("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111")]
    values += [("iban", c + iban_check(c, p) + p) for c, p in (("DE", number(18)), ("NO", number(11)), ("PL", number(24)))] + [("iban", "DE89 3704 0044 0532 0130 00")]
    df = spark.createDataFrame(values, "kind string, v string")
    out = df.select("v", "kind", pseudonyms.kind_of(F.col("v")).alias("found"), pseudonyms.pseudonym(F.col("v"), F.col("kind"), "k").alias("p")).collect()
    assert all(r["found"] == r["kind"] for r in out)
    assert {r["v"]: r["p"] for r in out} == {v: pseudonym_by_definition(v, kind, "k") for kind, v in values}
    long = "call 555-3824 or write. " * 3000
    bad = "000-12-3456 DE00370400440532013000 300.1.1.1 4111111111111112 155-3824 555-38245 2023-02-29"
    texts = spark.createDataFrame([(1, long), (2, bad), (3, None), (3, None), (4, "x" * 200_000)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["n_phone"]) for r in pseudonyms.pseudonym_report(texts).orderBy("doc_id").collect()]
    assert got[0] == (1, long.replace("555-3824", pseudonym_by_definition("555-3824", "phone", pseudonyms.DEMO_KEY)), 3000)
    assert got[1:] == [(2, bad, 0), (3, None, 0), (3, None, 0), (4, "x" * 200_000, 0)]


def quotes_by_definition(rows):
    """Links of quoted passages and lines, message by message."""

    def words(lines):
        return re.sub(r"[\s!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", " ", " ".join(lines).lower()).strip(" ")

    def passages(text):
        out = []
        for line in re.split("\r?\n", text or ""):
            marks = re.match(r"(?:>[ \t]?)*", line).group()
            level, body = marks.count(">"), line[len(marks) :]
            if body.strip(" ") and out and out[-1][0] == level:
                out[-1][1].append(body)
            elif body.strip(" "):
                out.append((level, [body]))
        return out

    wrote, quoted = defaultdict(set), defaultdict(set)
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        for level, lines in passages(text):
            keys = {words(lines)} | {w for w in map(lambda x: words([x]), lines) if len(w.split(" ")) >= 4}
            for k in keys - {""}:
                (quoted[conv, turn] if level else wrote[k]).add((k, level) if level else (conv, turn))
    out = {}
    for conv, turn, _, _ in rows:
        found, linked, replies, others = quoted.get((conv, turn), set()), 0, [], []
        for k, level in found:
            inside = [t for c, t in wrote[k] if c == conv and t < turn]
            first = min(wrote[k], default=None)
            if inside:
                replies.append((-level, max(inside)))
            elif first and first[0] != conv:
                others.append(first)
            linked += bool(inside) or bool(first and first[0] != conv)
        out[conv, turn] = (len(found), linked, max(replies)[1] if replies else None, min(others) if others else None)
    return out


def test_quotes_against_the_definition(spark):
    pick = random.Random(11)
    says = [" ".join(pick.choice("red green blue one two three cat dog sun rain".split()) for _ in range(pick.randrange(2, 9))) + pick.choice(".!?") for _ in range(40)]
    rows = []
    for conv in range(30):
        held = [["Everyone quotes this passage of many words."]]
        for turn in range(pick.randrange(1, 9)):
            own = pick.sample(says, pick.randrange(1, 4))
            quote = [("> " if pick.random() < 0.5 else ">>" if pick.random() < 0.5 else "> > ") + x.upper() for x in pick.choice(held)] if pick.random() < 0.7 else []
            rows.append((conv, turn, "user", "\n".join([*quote, *own]) if pick.random() < 0.95 else None))
            held.append(own)
    rows += [(30, t, "user", ("> " + " ".join(says) + "\n") * 300 + says[0]) for t in range(2)] + [(31, 0, "user", "Everyone quotes this passage of many words.")] + [(32, 0, "a", "twice the same turn here"), (32, 0, "b", "> twice the same turn here\nother")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("p", F.lit("clash")).withColumn("lines", F.lit("clash"))
    out = quote_linking.link_quotes(df).collect()
    want = quotes_by_definition(rows)
    got = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["reply_to_turn"], (r["other_conv_id"], r["other_turn"]) if r["other_conv_id"] is not None else None) for r in out}
    assert len(out) == len(rows) and got == want and sum(v[1] for v in want.values()) > 30
    up = {k: v[2] for k, v in want.items()}
    for r in out:
        turn, depth = r["turn"], 0
        while up[r["conv_id"], turn] is not None:
            turn, depth = up[r["conv_id"], turn], depth + 1
        assert (r["thread_turn"], r["depth"]) == (turn, depth)
    assert all(">" not in (r["text"] or "") for r in out)


def water_fill(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_, target, total = set(names), {}, 1.5 * sum(size.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_mixing(spark, sf, which):
    df = docs(spark) if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    source = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
    size = Counter()
    for _, s, n in source:
        size[s] += n
    want = water_fill(dict(size))
    out = source_mixing.mix_report(df).collect()
    assert sorted((repr(r["doc_id"]), r["size"]) for r in out) == sorted((repr(i), n) for i, _, n in source)
    assert {(r["source_size"], round(r["target"], 3)) for r in out} == {(size[s], round(want[s], 3)) for s in size}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert abs(sum(r["taken"] for r in out) - sum(want.values())) <= max(3 * len(size), 0.01 * sum(want.values()))
    assert rows_of(source_mixing.mix_report(df)) == sorted((tuple(r) for r in out), key=repr)
    if which == "table":
        of = {i: s for i, s, _ in source}
        taken = Counter()
        for r in out:
            taken[of[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in size)
    assert source_mixing.apply_mix(df).columns == df.columns


def test_mixing_reaches_small_sources(spark):
    """Sources of less than one block, and of a few, beside a hot one: each takes its target."""
    size = {"hot": 200_000, "a": 300, "b": 1500, "c": 16_000}
    rows = [(k, s, "w " * 100) for k, s in enumerate(s for s, n in size.items() for _ in range(n // 100))]
    out = source_mixing.mix_report(spark.createDataFrame(rows, "doc_id long, source string, text string"), blocks=64).collect()
    of, taken, want = {k: s for k, s, _ in rows}, Counter(), water_fill(size)
    for r in out:
        taken[of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size), (taken, want)


def test_mixing_takes_the_same_texts_in_any_row_order(spark):
    """Rows without an id and of one length."""
    rows = [(None, "a" if k % 3 else "b", f"t{k} " + "w " * 99) for k in range(400)]
    got = [sorted(map(tuple, source_mixing.mix(spark.createDataFrame(r, "doc_id long, source string, text string"), blocks=64).select("text", "_mx.taken").collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len({n for _, n in got[0]}) > 1


def test_blocks_are_drawn_by_the_quotas_of_the_shards(spark):
    size = {"hot": 200_000, "a": 300, "b": 1500, "c": 16_000}
    sizes = spark.createDataFrame([(s, n) for s, n in size.items()], "source string, source_size long")
    targets = source_mixing.source_targets(sizes).withColumn("block", F.lit(2000).cast("long")).cache()
    name = {r["place"]: r["source"] for r in targets.collect()}
    seats = {(r["place"], r["shard"]): r["seats"] for r in source_mixing.apportion(targets, 8).collect()}
    want = water_fill(size)
    total = round(sum(want.values()) / 2000)
    best = sorted(((want[s] / (2 * k + 1), s) for s in size for k in range(total)), reverse=True)[:total]
    assert Counter(s for _, s in best) == Counter({name[p]: sum(n for (q, _), n in seats.items() if q == p) for p in name if any(q == p for q, _ in seats)})
    draws = source_mixing.draw_blocks(targets, shards=8).collect()
    got, words = Counter(), Counter()
    for r in draws:
        got[r["place"], r["shard"]] += 1
        words[name[r["place"]]] += r["words"]
    assert all(words[s] == round(want[s]) for s in size)
    last = {p: max((s for q, s in seats if q == p), default=0) for p in name}
    assert all(got[k] == n for k, n in seats.items() if k[1] != last[k[0]]) and all(abs(got[k] - n) <= 3 for k, n in seats.items())
    assert len({(r["place"], r["turn"]) for r in draws}) == len(draws)


def test_clashing_names_do_not_matter(spark):
    """Columns named as the operators' own."""
    names = ("_mx", "_wq_s", "_wq_p", "_tk", "_sh", "_fp", "_dc_key", "_nd_row", "row", "key", "fp", "size", "shard", "slot", "number", "carried", "component")
    df = docs(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("clash").alias(n) for n in names])
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for out in (source_mixing.apply_mix(df), quality_rules.filter_quality(df), decontamination.decontaminate(df, items), minhash_dedup.drop_near_duplicates(df)):
        assert out.columns == df.columns and {r["_mx"] for r in out.collect()} <= {"clash"}
    for out in (slot_sharding.shard_report(df), token_counts.token_report(df), pseudonyms.pseudonym_report(df), source_mixing.mix_report(df), quality_rules.quality_report(df), suffix_dedup.repeats_report(df), minhash_dedup.near_duplicates(df), decontamination.contamination_report(df, items)):
        assert out.count() == df.count()
    assert pseudonyms.pseudonymise(df).count() == token_counts.with_token_counts(df).count() == slot_sharding.shard(df).count() == source_mixing.mix(df).count() == df.count()


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_sharding(spark, sf, which):
    df = docs(spark) if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    out = slot_sharding.shard_report(df).collect()
    raw = [(i, (t or "").encode()) for i, t in pairs(df)]
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((repr(i), len(b) + 1, zlib.crc32(b)) for i, b in raw)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(8))
    if which == "table":
        load = [sum(r["size"] for r in rs) for rs in by.values()]
        assert len(load) == 8 and max(load) <= 1.02 * min(load)


def test_slot_map_versions(spark, tmp_path):
    weight = {s: (s * 7919) % 101 + 1 for s in range(4096)}
    first = slot_sharding.SlotMap.dealt(8)
    even = first.rebalanced(weight)
    grown = even.grown(weight)
    load = Counter()
    for s, shard in enumerate(grown.owner):
        load[shard] += weight[s]
    assert (first.version, even.version, grown.version) == (1, 2, 3) and grown.shards == 9
    assert all(a == b or b == 8 for a, b in zip(even.owner, grown.owner, strict=True)) and max(load.values()) < 1.05 * min(load.values())
    even.save(spark, str(tmp_path / "map"))
    even.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert slot_sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown and slot_sharding.SlotMap.load(spark, str(tmp_path / "map"), 2) == even


def test_the_stored_map_is_loaded_and_edited(spark, sf, tmp_path):
    df, path = spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "map")
    first = {(r["doc_id"], r["_sh"]["shard"]) for r in slot_sharding.shard(df, map_path=path).collect()}
    again = {(r["doc_id"], r["_sh"]["shard"]) for r in slot_sharding.shard(df, map_path=path).collect()}
    assert first == again and slot_sharding.SlotMap.versions(spark, path) == [1, 2] and len(slot_sharding.SlotMap.load(spark, path).owner) == 4096
    more = df.unionByName(df.limit(60).withColumn("text", F.repeat("text", 9)))
    moved = {(r["doc_id"], r["_sh"]["shard"]) for r in slot_sharding.shard(more, map_path=path).collect()}
    assert slot_sharding.SlotMap.versions(spark, path) == [1, 2, 3] and len(moved & first) > 0.5 * len(first)
    with pytest.raises(ValueError):
        slot_sharding.shard(df, shards=9, map_path=path)
    with pytest.raises(ValueError):
        slot_sharding.SlotMap(2, 8, tuple([0] * 4096)).save(spark, path)


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_quality_statistics(spark, sf, which):
    df = docs(spark) if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    want = []
    for i, text in pairs(df):
        w = WORD.findall(text or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    out = quality_rules.quality_report(df)
    assert rows_of(out.drop("kept", "quality_probability")) == sorted(want, key=repr)
    assert out.where("kept and base_failed").count() == 0
    assert quality_rules.filter_quality(df).columns == df.columns


def test_quality_matches_labels(spark, sf):
    out = quality_rules.quality_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = {(r["quality"], r["kept"]): r["count"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").join(out, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert found.get((0, True), 0) + found.get((1, False), 0) <= 0.02 * sum(found.values())


def test_fitted_accuracies_follow_agreement(spark):
    votes = [([1, 0, 0] if k % 2 else [1, -1, -1]) for k in range(400)] + [[1, 0, -1]] * 10
    names = [quality_rules.PREFIX + r for r in quality_rules.RULES]
    rows = [tuple({"sentences": v[0], "symbols": v[1], "repetition": v[2]}.get(r, -1) for r in quality_rules.RULES) for v in votes]
    model = quality_rules.fit(spark.createDataFrame(rows, names))
    assert model["repetition"] >= model["symbols"] > 0.8 and model["sentences"] <= quality_rules.VOUCHER_MOST


def test_good_votes_outvote_a_weak_rule(spark):
    """Nobody backs the bad votes of shouting; those of symbols, repetition and sentences back each other."""
    votes = [{}] * 400 + [{"shouting": 0}] * 60 + [{"symbols": 0, "repetition": 0, "sentences": 0}] * 60
    rows = [tuple(v.get(r, 1) for r in quality_rules.RULES) for v in votes]
    model = quality_rules.fit(spark.createDataFrame(rows, [quality_rules.PREFIX + r for r in quality_rules.RULES]))
    assert model["shouting", quality_rules.BAD] < 0.6 < 0.9 < model["symbols", quality_rules.BAD]
    prose = [" ".join(f"{chr(97 + (k * j + j) % 26)}{chr(97 + (k + 3 * j) % 26)}rd{j}".rstrip("0123456789") + "xyz"[(k + j) % 3] + chr(97 + j % 26) + chr(97 + j // 26) + ("." if j % 9 == 8 else "") for j in range(120)) for k in range(60)]
    loud = [t.replace(".", "!!!") for t in prose[:8]]
    junk = [" ".join(["ab#$% cd&&& ef***"] * 60) + f" {k}" for k in range(12)]
    texts = prose + loud + junk
    out = quality_rules.quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    bad = quality_rules.rule_votes(quality_rules.text_statistics(F.col("text")))["shouting"]
    assert spark.createDataFrame([(t,) for t in loud], "text string").where(bad == quality_rules.BAD).count() == len(loud)
    assert {r["doc_id"] for r in out.where("kept").collect()} == set(range(len(prose) + len(loud)))


def repeats(table):
    order = sorted({(i, t or "") for i, t in table}, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    seen, done = set(), {}
    for i, t in order:
        b = t.encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 99):
            if (s := b[k : k + 100]) in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(s)
        done[i, t] = (len(b), sum(cover), sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return sorted(((i, *done[i, t or ""]) for i, t in table), key=repr)


@pytest.mark.parametrize("which", ["awkward", "runs", "table"])
def test_repeated_strings(spark, sf, which):
    if which == "awkward":
        df = docs(spark)
    elif which == "runs":
        mid = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400))
        texts = ["a" * 500, "ab" * 200, mid, "xx" + mid[50:149], "yy" + mid[50:150] + "zz", mid[:120] + "Q" + mid[121:300], "é" * 150, "é" * 49, mid[150:] + mid[:150], "a" * 99, "a" * 100]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(suffix_dedup.repeats_report(df)) == repeats(pairs(df))


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_token_counts(spark, sf, which):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    df = docs(spark) if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    if which == "awkward":
        more = ["don't DON'T 'S we'll's", "<|startoftext|>a<|endoftext|><|endoftext|", "ǅ ŉ ß ẞ ﬁ", "áé", "\x00\x1c\x7f b", "1²½٣", "--- --..--", " x　y\xa0z", "😀👍🏽", "ΑΣ ΑΣΒ"]
        df = df.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    table = pairs(df)
    want = [(i, len((t or "").encode()), len(e.ids), len(e.ids) > 2048) for (i, t), e in zip(table, library.encode_batch([t or "" for _, t in table], add_special_tokens=False), strict=True)]
    assert rows_of(token_counts.token_report(df)) == sorted(want, key=repr)


def test_tokens_of_another_file_are_counted_by_its_own_rules(tmp_path):
    import json

    from tokenizers import Tokenizer

    made = json.load(open(token_counts.vocabulary_path()))
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[^\\s]+"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    text, mixed = "don't stop at 1234, it's fine", "plain words, then 漢字 words e\u0301 and\n\u0308x ΑΣ. ok"
    for file in (str(path), token_counts.vocabulary_path()):
        counter, library = token_counts.Counter(file), Tokenizer.from_file(file)
        assert counter.fast == (file != str(path))
        assert [counter.count(t) for t in (text, mixed)] == [len(e.ids) for e in library.encode_batch([text, mixed], add_special_tokens=False)]


def test_archives(spark, sf):
    big = "<p>" + "content " * 200
    awkward = [(1, "http://a", None), (2, None, ""), (3, "http://a b\r\nX: y", big), (5, "u", big), (5, "u", big), (4, "u", big), (None, "u", big), (6, "u", "small"), (7, "u", "small"), (8, "u", "WARC/1.1\r\n\r\n\r\n\r\n é"), (9, "u", "é" * 500)]
    for df in (spark.createDataFrame(awkward, "page_id long, url string, html string").withColumn("salt", F.lit("clash")), spark.read.parquet(f"{sf}/pages.parquet")):
        rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
        top = defaultdict(lambda: None)
        for i, b in rows:
            if i is not None:
                top[b] = i if top[b] is None else max(top[b], i)
        n = Counter(b for _, b in rows)
        again = {(i, b): len(b) >= 1000 and n[b] > 1 and i != top[b] for i, b in rows}
        want = [(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again[i, b] else "response", top[b] if again[i, b] else None) for i, b in rows]
        assert rows_of(warc.archive_report(df)) == sorted(want, key=repr)


def test_archive_reader_rejects_damage(spark, tmp_path):
    record = warc.record_bytes(1, "u", "x" * 50, 50, hashlib.sha1(b"x" * 50).hexdigest(), "response", None)
    assert warc.read_record(record)[-1] == b"x" * 50
    for bad in (record.replace(b"WARC/1.1", b"WARC/9"), record[:-1], record.replace(b"xxx\r\n", b"xyx\r\n"), record.replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(ValueError):
            warc.read_record(bad)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), folder).collect()
    data = open(manifest[0]["archive"], "rb").read()
    for bad in (data[4:], data[:-3]):
        with pytest.raises((ValueError, Exception)):
            list(warc.frames(memoryview(bad)))


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friend.\nHow are you doing today?"), (1, 1, "assistant", "> How are you doing today?\nFine."), (1, 2, "user", ">> How are you doing today?\n> Fine.\nGood to hear that, really."), (1, 3, "user", "> hello there  MY friend\nhi"),
        (2, 0, "user", "> Good to hear that, really.\nok"), (2, None, "user", None), (None, 1, "user", "> Fine."), (2, 1, None, ""), (2, 1, None, ""),
    ]
    out = quote_linking.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert out.count() == len(rows)
    assert [got[1, t]["reply_to_turn"] for t in range(4)] == [None, 0, 1, 0] and [got[1, t]["depth"] for t in range(4)] == [0, 1, 2, 1]
    assert [got[1, t]["text"] for t in (1, 2, 3)] == ["Fine.", "Good to hear that, really.", "hi"] and got[2, None]["text"] is None
    assert (got[2, 0]["other_conv_id"], got[2, 0]["other_turn"], got[2, 0]["thread_turn"]) == (1, 2, 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (
        minhash_dedup.near_duplicates(empty), quote_linking.link_quotes(talks), decontamination.contamination_report(empty, items), pseudonyms.pseudonym_report(empty), source_mixing.mix_report(empty), slot_sharding.shard_report(empty), quality_rules.quality_report(empty), suffix_dedup.repeats_report(empty), token_counts.token_report(empty), warc.archive_report(pages),
    ):
        assert out.count() == 0
    some = spark.createDataFrame([(1, "a b c", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert decontamination.decontaminate(some, items).count() == 2


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
