"""Operators 2, 3, 5, 6, 7 and 8 against brute force."""

import datetime as dt
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgrid.llm import linededup, lm, mixing, simhash, topk, warc
from quillgrid.llm.common import table
from quillgrid.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lines(rows, ratio=0.10, least=2):
    pages, lines = Counter(s for _, s, _ in rows), Counter()
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    for _, s, t in rows:
        lines.update((s, x) for x in {bare(x) for x in (t or "").split("\n")} if x)
    bad = {k for k, n in lines.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, bare(x)) not in bad)) for i, s, t in rows]


def test_line_dedup(spark, odd_docs, no_docs):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", " menu ", "foot", f"own {i}", f"rare {i % 30}", ""]) for _ in range(6))) for i in range(120)] + [(500, "b", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = sorted((r["doc_id"], r["text"]) for r in linededup.drop_boilerplate(df, "source").collect())
    want = sorted(plain_lines(rows))
    assert got == want and any("menu" not in (t or "menu") for _, t in got)
    assert linededup.drop_boilerplate(odd_docs, "source").count() == odd_docs.count()
    assert linededup.drop_boilerplate(no_docs, "source").count() == 0
    named = odd_docs.withColumns({c: F.lit("mine") for c in ("lines", "__host", "__lines", "__n_lines")})
    out = linededup.drop_boilerplate(named, "source")
    assert {(r["lines"], r["__host"], r["__lines"], r["__n_lines_"]) for r in out.collect()} == {("mine",) * 4} and out.count() == odd_docs.count()


def test_lines_of_one_page_stay(spark):
    df = spark.createDataFrame([(1, "s", "a\nb"), (2, "s", "a\nc"), (3, "t", "a\nd")], "doc_id bigint, source string, text string")
    assert sorted(r["text"] for r in linededup.drop_boilerplate(df, "source").collect()) == ["a\nd", "b", "c"]


RECORD = "record_id bigint, warc_type string, target_uri string, warc_date timestamp, status int, headers map<string,string>, body string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.X.org:80/a/", at(0), 200, {"ETag": '"v1"', "Content-Type": "text/html", "Age": "1"}, "one"),
        (2, "response", "https://x.org/a", at(100), 200, {"ETag": '"v2"', "Last-Modified": "d"}, "two"),
        (3, "response", "https://x.org/a", at(150), 500, {"ETag": '"v3"'}, "error"),
        (10, "revisit", "http://x.org/a#f", at(50), 304, {"etag": 'W/"v1"', "Content-Type": "x", "Date": "now"}, None),
        (11, "revisit", "http://x.org/a", at(200), 304, {"etag": '"v1"'}, None),
        (12, "revisit", "http://x.org/a", at(200), 304, {"last-modified": "d"}, None),
        (13, "revisit", "http://x.org/a", at(200), 304, None, None),
        (14, "revisit", "http://x.org/b", at(200), 304, {"etag": '"v1"'}, None),
        (15, "revisit", "http://x.org/a", at(0), 304, {"etag": '"v1"'}, None),
        (16, "revisit", None, at(0), 304, {"etag": '"v1"'}, None),
        (17, "revisit", "http://x.org/a", None, 304, {"etag": '"v1"'}, None),
        (11, "revisit", "http://x.org/a", at(200), 304, {"etag": '"v1"'}, None),
        (2, "response", "https://x.org/a", at(100), 200, {"ETag": '"v2"', "Last-Modified": "d"}, "two"),
    ]
    df = spark.createDataFrame(rows, RECORD)
    for seconds in (60, 3600, 10**9):
        got = {r["record_id"]: r for r in warc.resolve_revisits(df.withColumn("extra", F.lit(1)), seconds).collect()}
        assert {k: (r["outcome"], r["matched_id"], r["body"]) for k, r in got.items()} == {
            10: ("resolved", 1, "one"), 11: ("mismatch", 2, None), 12: ("resolved", 2, "two"), 13: ("unverified", 2, None),
            14: ("unmatched", None, None), 15: ("resolved", 1, "one"), 16: ("unmatched", None, None), 17: ("unmatched", None, None),
        }
    assert got[10]["headers"] == {"etag": 'W/"v1"', "content-type": "text/html", "age": "1", "date": "now"}
    assert got[10]["canonical_url"] == "x.org/a"
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_latest_full_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(3)}", at(rng.randrange(40)), i, rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, at timestamp, record_id bigint, full boolean")
    want = {}
    for u, t, i, full in rows:
        if not full:
            want[i] = max(((t2, i2) for u2, t2, i2, f2 in rows if f2 and u2 == u and (t2, i2) < (t, i)), default=(None, None))[1]
    got = {r["record_id"]: r["full_id"] for r in warc.latest_full(df, 300).collect()}
    assert got == want


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("bucket", [1, 3, 24])
def test_links_give_the_components(spark, bucket):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {rng.getrandbits(64) for _ in range(40)}
    for s in seeds:
        for _ in range(25):
            v = s
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.choice([0, 1, 31, 32, 33, 63, rng.randrange(64)])
            values.add(v)
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp bigint"), bucket).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in edges)
    linked = defaultdict(set)
    for r in edges:
        linked[r["a"]].add(r["b"])
        linked[r["b"]].add(r["a"])
    groups, seen = set(), set()
    for v in map(signed, values):
        if v not in seen:
            todo, own = [v], set()
            while todo:
                x = todo.pop()
                if x not in own:
                    own.add(x)
                    todo += linked[x]
            seen |= own
            groups.add(frozenset(own))
    want = defaultdict(set)
    for v, r in plain_components(values).items():
        want[r].add(signed(v))
    assert groups == {frozenset(g) for g in want.values()}


def test_simhash_on_documents(spark, small):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op5_simhash(spark, small).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in table(spark, small, "documents").collect()}
    roots = plain_components(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert got == {i: (f, least[roots[f]]) for i, f in fps.items()}


def plain_copies(texts):
    """Component roots (places in ``texts``) of near duplicates: words' fingerprints within 5 bits, 5-word shingles 4/5 alike."""
    words = [WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set() for w in words]
    hashes = [[xxhash.xxh64_intdigest(x.encode(), 42) for x in set(w)] for w in words]
    fps = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in hashes]
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(texts)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 5 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if near:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(v) for v in root]


@pytest.mark.parametrize("hubs", [1, 16])
def test_similar_copies(spark, hubs):
    """Groups of near copies, larger than a round's hubs and only in part similar enough, against all pairs."""
    rng, texts = random.Random(3), []
    for g in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(30):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(120)] = f"x{rng.randrange(9)}"
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    texts += ["", " ", None, "one", "one two", "One Two"]
    want, docs = plain_copies(texts), spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_copies(docs, hubs=hubs).collect()}
    assert got == dict(enumerate(want)) and 8 < len(set(want)) < 100


def test_crowds_of_near_copies_are_compared_by_sketch_first(spark, monkeypatch):
    """Short texts with near fingerprints that are mostly not alike enough: few pairs come to the shingles themselves."""
    rng, texts, seen, alike = random.Random(5), [], [], simhash._alike
    base = [f"w{rng.randrange(3000)}" for _ in range(60)]
    for _ in range(200):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(60)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(own))

    def counted(pairs, shingles):
        found = alike(pairs, shingles)
        seen.append((pairs.count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "_alike", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_copies(docs).collect()}
    assert got == dict(enumerate(plain_copies(texts)))
    compared, linked = seen[0]
    assert 100 < linked <= compared < 1.6 * linked, seen


def test_simhash_edges(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["component_id"])
    assert by[2] == by[3] == by[4] == {2} and by[None] == {None}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in kept.collect()) == [(0, "no i"), (1, "The "), (2, ""), (5, "w0 w"), (6, "anot"), (6, "same"), (7, "日本語 "), (8, "xxxx")]
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.similar_copies(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    named = odd_docs.withColumn("fp", F.lit("mine")).withColumn("node", F.lit("mine")).withColumn("__hash", F.lit("mine"))
    assert {r["node_"] for r in simhash.similar_copies(named, keep=("node",)).collect()} == {"mine"}
    assert {r["fp_"] for r in simhash.near_duplicates(named, keep=("fp",)).collect()} == {"mine"}
    assert simhash.keep_one(named).columns == named.columns and simhash.keep_one(named).count() == kept.count()


def test_no_table_of_fingerprints_is_broadcast(spark, monkeypatch):
    import sys

    plans, written, rng = [], simhash.materialize, random.Random(9)
    bases = [[f"w{rng.randrange(500)}" for _ in range(600)] for _ in range(20)]
    docs = spark.createDataFrame([(5 * i + k, " ".join([*words, f"end{k}"])) for i, words in enumerate(bases) for k in range(5)], "doc_id bigint, text string")

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (simhash, sys.modules["quillgrid.llm.components"]):
        monkeypatch.setattr(module, "materialize", noted)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "1g")
    try:
        last = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, old)
    assert len(plans) > 9 and not [p for p in [*plans, last] if "BroadcastHashJoin" in p]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect():
        got[r["root"]].add(r["node"])
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = defaultdict(set)
    for v, r in root.items():
        want[r].add(v)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")) is None


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / total for s in free}
        for s in over:
            capped[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(capped.values())


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mixing(spark, block):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(150)] + [(7, "x y", "a"), (7, "x y", "a"), (None, "p q r", "b"), (900, None, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df, block=block).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = plain_targets(dict(sizes))
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    names = {(i, len(WORDS.findall(t or ""))): s for i, t, s in rows}
    for r in out:
        s = names[r["doc_id"], r["size"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert target == pytest.approx(want)
    assert dict(taken) == {s: round(x) for s, x in want.items()}
    again = mixing.mix(df.repartition(3), block=block).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


@pytest.mark.parametrize("block", [5, 128])
def test_taken_by_brute_force(spark, small, block):
    docs = table(spark, small, "documents")
    keys = {r["doc_id"]: r["k"] % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(6)).alias("k")).collect()}
    size = {r["doc_id"]: len(WORDS.findall(r["text"] or "")) for r in docs.collect()}
    by_source = defaultdict(list)
    for r in docs.collect():
        by_source[r["source"]].append(r["doc_id"])
    targets, want = plain_targets({s: sum(size[i] for i in ids) for s, ids in by_source.items()}), {}
    for s, ids in by_source.items():
        order = sorted(ids, key=lambda i: (keys[i], i))
        words = [i for i in order for _ in range(size[i])]
        blocks = [words[i : i + block] for i in range(0, len(words), block)]
        left, taken, rank = round(targets[s]), Counter(), 0
        while left > 0:
            part = blocks[rank % len(blocks)][:left]
            taken.update(part)
            left, rank = left - len(part), rank + 1
        want |= {i: taken[i] for i in ids}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=block).collect()} == want


def test_first_slots_and_the_order_of_the_mix(spark, small):
    """Each document's first slot, and the rows of the mix by slot, from the schedule in plain Python."""
    docs = table(spark, small, "documents")
    out = {r["doc_id"]: r for r in mixing.mix(docs, block=32).collect()}
    rows = mixing.taken_rows(docs, block=32).collect()
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert words == Counter({i: r["taken"] for i, r in out.items() if r["taken"]})
    slots = sorted(r["first_slot"] for r in out.values() if r["taken"])
    assert slots[0] == 0 and all(r["first_slot"] is None for r in out.values() if not r["taken"])
    seen = list(dict.fromkeys(r["doc_id"] for r in rows))
    assert [out[i]["first_slot"] for i in seen] == sorted(out[i]["first_slot"] for i in seen)
    half = Counter(r["source"] for r in rows[: len(rows) // 2])
    assert len(half) == len({r["source"] for r in rows})  # every source is in either half of the mix


def test_slots_are_golden_ratio_points(spark):
    sources = mixing._plan(mixing.source_targets(spark.createDataFrame([("a", 900), (None, 400)], "source string, source_size bigint")), 10)
    rows = {r["sid"]: r for r in sources.collect()}
    total = sum(r["needed"] for r in rows.values())
    a, _ = mixing.rotation(total)
    assert abs(a / total - mixing.GOLDEN) < 0.05
    for r in mixing.schedule(sources, total, 10).collect():
        own = rows[r["sid"]]
        assert own["first"] <= r["slot"] * a % total < own["first"] + own["needed"]


def test_schedule_is_even(spark):
    sources = mixing._plan(mixing.source_targets(spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 1000)], "source string, source_size bigint")), 10)
    total = sources.agg(F.sum("needed")).first()[0]
    slots = mixing.schedule(sources, total, 10).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(total))
    needed = {r["sid"]: r["needed"] for r in sources.collect()}
    seen = Counter()
    for n, r in enumerate(slots, 1):
        assert r["rank"] == seen[r["sid"]]
        seen[r["sid"]] += 1
        assert all(abs(seen[s] - n * needed[s] / total) < 6 for s in needed)


def test_modular_products(spark):
    m = 10**12 + 39
    a, inverse = mixing.rotation(m)
    df = spark.createDataFrame([(0,), (1,), (m - 1,), (123456789012,)], "x bigint")
    got = df.select("x", mixing._times_mod(F.col("x"), inverse, m).alias("y")).collect()
    assert all(r["y"] == r["x"] * inverse % m for r in got) and a * inverse % m == 1


def test_taken_rows(spark, odd_docs, no_docs):
    out = mixing.taken_rows(odd_docs).collect()
    assert mixing.taken_rows(odd_docs).columns == odd_docs.columns
    texts = {r["text"] for r in odd_docs.collect()}
    cut = [r for r in out if r["text"] not in texts]
    assert len(cut) <= 3 and all(any((t or "").startswith(r["text"]) for t in texts) for r in cut)
    size = lambda rows: sum(len(WORDS.findall(r["text"] or "")) for r in rows)
    assert size(out) == pytest.approx(1.5 * size(odd_docs.collect()), abs=3)
    assert mixing.taken_rows(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    named = odd_docs.withColumn("size", F.lit("mine"))
    assert {r["size_"] for r in mixing.mix(named, keep=("size", "score")).collect()} == {"mine"}
    assert [c for c in mixing.mix(named, keep=("size", "score")).columns if c.startswith("s")] == ["size_", "score", "size", "source_size"]
    again = [(r["doc_id"], r["text"]) for r in mixing.taken_rows(odd_docs.repartition(5, "n_chars")).collect()]
    assert again == [(r["doc_id"], r["text"]) for r in out]


def test_base_scores(spark, small):
    rows = lm.op7_suffixtree(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    tokens = {i: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in texts.items()}
    trains = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    count = Counter(w for i in trains for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in trains, len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r["score"] < 0


def test_beats_the_base_on_held_out_texts(spark):
    """From a few thousand documents on; on fewer, unnormalized add-one unigrams are hard to beat."""
    held = lm.op7_suffixtree(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.97 * held[1]


def plain_tree(texts, order, share, divergence):
    counts = defaultdict(Counter)
    for t in texts:
        s = b"\n" + lm.symbols(t.encode()) + b"\n"
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                counts[s[i - k : i]][s[i]] += 1
    total = sum(counts[b""].values())
    chance = {b"": None}

    def prob(context, symbol):
        c = counts[context]
        below = prob(context[1:], symbol) if context else 1 / 256
        return (c[symbol] + len(c) * below) / (sum(c.values()) + len(c)) if c else below

    kept = {b""}
    for c in counts:
        own, up = sum(counts[c].values()), counts[c[1:]]
        if c and own >= share * total:
            gain = sum(n / own * math.log((n / own) / (up[a] / sum(up.values()))) for a, n in counts[c].items())
            if gain >= divergence and gain * own >= lm.EVIDENCE * len(counts[c]):
                kept.add(c)
    assert chance

    def score(text):
        s, out = b"\n" + lm.symbols((text or "").encode()) + b"\n", 0.0
        for i in range(1, len(s)):
            state = next(s[i - k : i] for k in range(min(order, i), -1, -1) if s[i - k : i] in kept)
            out += math.log10(prob(state, s[i]))
        return out

    return score


def test_tree_tables_score_as_the_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 900)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "then", "there", "Café", "x1", "日本"]) for _ in range(rng.randrange(12))) for _ in range(150)]
    rows = [(i, i % 7 != 2, t) for i, t in enumerate([*texts, "unseen 日 zz", None])]
    got = lm.tree_scores(spark.createDataFrame(rows, "i int, trains boolean, text string"), "text", "trains").collect()
    trained = [t or "" for _, yes, t in rows if yes]
    score = plain_tree(trained, lm.DEPTH, lm.LEAST / sum(len(lm.symbols(t.encode())) + 1 for t in trained), lm.DIVERGENCE)
    assert len(got) == len(rows)
    assert [r["score"] for r in sorted(got, key=lambda r: r["i"])] == pytest.approx([score(t) for _, _, t in rows], rel=1e-5)


def test_kept_contexts_grow_with_the_texts(spark):
    """A share of all positions kept as many contexts of ten times the text, or fewer."""
    few, many = (
        lm.kept_contexts(table(spark, f"/root/testdata/{d}", "documents").select(F.lit(True).alias("trains"), "text"), "text", "trains").where("k = 6").agg(F.sum("n")).first()[0]
        for d in ("sf0.01", "sf0.1")
    )
    assert many > 1.5 * few


def test_language_model_edges(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "score", F.lit("clash").alias("n_known"), lm.held_out(F.col("doc_id")).alias("held_out"), F.lit(True).alias("trains"))
    out = lm.base_scores(lm.tree_scores(docs, "text", "trains"), "text", ["doc_id", "held_out", "score", "score_", "n_known"], "trains").collect()
    assert len(out) == docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert {(r["score_"], r["n_known_"]) for r in out} == {("clash", "clash")}
    untrained = lm.tree_scores(docs.withColumn("trains", F.lit(False)), "text", "trains")
    assert {r["doc_id"]: r["score"] for r in untrained.collect()}[8] == pytest.approx(5001 * math.log10(1 / 256), rel=1e-5)
    none = lm.base_scores(untrained, "text", ["doc_id", "score"], "trains").collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in none} == {(0, 0, 0.0)}
    empty = no_docs.select("doc_id", "text", F.lit(True).alias("trains"))
    assert lm.base_scores(lm.tree_scores(empty, "text", "trains"), "text", ["doc_id", "score"], "trains").count() == 0
    assert lm.symbols(b"a\x00b") != lm.symbols(b"a\x01b")


def plain_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


@pytest.mark.parametrize("n", [3, 700])
def test_top_k(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "ROW_BLOCK", 100)
    monkeypatch.setattr(topk, "WAVE_BYTES", 1000)
    monkeypatch.setattr(topk, "SEEDS", 64)
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(n)]
    rows += [(1001, rows[1][1]), (1002, rows[1][1]), (1003, None), (1004, [1.0, None]), (1005, [float("nan")] * 24), (None, rows[0][1]), (1050, [float("inf")] * 24), (1100, []), (1006, [0.5, 0.25]), (1007, rows[1][1]), (1007, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == plain_top(rows)
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_repeated_queries_ask_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2, 128 * 256), (2, 1, 0)]


def embeddings(spark, sf):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.floor(256 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64).T


def test_most_products_are_skipped(spark):
    """On the table of sf0.1, of which no candidate is far shorter than another."""
    ids, c = embeddings(spark, "/root/testdata/sf0.1")
    own = ids % 50 == 0
    floors = topk._first_floors(ids[own], c[:, own], ids[:500], c[:, :500], 5)
    wave = topk.Wave([{"ids": ids[own].tobytes(), "floors": floors.tobytes(), "dim": len(c), "n": int(own.sum()), "data": np.ascontiguousarray(c[:, own]).tobytes()}], 5)
    best, made, whole = wave.search(iter([(ids, c)]))
    assert made < 0.5 * whole
    scores = c[:, own].T @ c
    for i, b in enumerate(best):
        want = sorted((-int(x), int(j)) for x, j in zip(scores[i], ids, strict=True) if j != b.own)[:5]
        assert [(-int(x), int(j)) for x, j in zip(b.scores, b.ids, strict=True)] == want


def test_bounds_only_drop_what_cannot_win():
    rng = np.random.default_rng(1)
    c = np.floor(rng.integers(-40, 40, size=(64, 4000)) * (0.2 + 3 * (rng.random(4000) < 0.02))).astype(np.int64)
    ids, q = np.arange(4000), c[:, :3]
    wave = topk.Wave([{"ids": ids[:3].tobytes(), "floors": np.full(3, -np.inf).tobytes(), "dim": 64, "n": 3, "data": np.ascontiguousarray(q).tobytes()}], 5)
    best, made, whole = wave.search((ids[a : a + 500], c[:, a : a + 500]) for a in range(0, 4000, 500))
    for own, b in enumerate(best):
        want = sorted(((-int(q[:, own] @ c[:, j]), j) for j in range(4000) if j != own))[:5]
        assert [(int(j), int(s)) for j, s in zip(b.ids, b.scores, strict=True)] == [(j, -s) for s, j in want]
    assert made < 0.5 * whole
