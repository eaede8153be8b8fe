"""Each operator against a brute-force version on small fixtures, and on hard rows."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.llm import exact_topk, language_id, line_dedup, media, mixing, quality, queries, sentencepiece_codec, sharding
from quakeframe.llm.near_dedup import near_duplicates
from quakeframe.llm.url_filters import Automaton, Rule, filter_urls

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}" for i in range(60000))
HARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", None),
    (3, "", "en", "b"),
    (4, None, None, "b"),
    (None, "one two\n\n three ", "de", "a"),
    (5, "one two", "de", "a"),
    (6, "One\ttwo", None, "c"),
    (7, "  \n\t ", "fr", "c"),
    (8, LONG, "en", "a"),
    (9, "x" * 300000, "en", "a"),
    (10, "日本語 テキスト 🙂 é ▁ <s>", "ja", "d"),
    (11, "\n".join(["License line"] * 3 + ["unique words here"]), "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ["size", "score", "ids", "n_lines", "media", "shard", "stats", "before", "host", "decoded", "component_id", "n_bytes"]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA], F.length("text").cast("long").alias("n_chars"))


@pytest.fixture(scope="module")
def empty(hard):
    return hard.filter(F.lit(False))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# --- 1: URL filters


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = raw.translate(LOW), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls_match_plain_rules(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "x", "http://", "http://COM/en/", "http://a.b.COM/en/7?x", "http://xcom/en/", "http://example.com/en/71#f", "http://net/de/8", "http://example.net/de/8",
             "http://org/es/" + "y" * 100000, "http://" + "h" * 5000 + ".org/es/", "ftp://q.org?/es/", "http://é.org/es/ü"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, queries.RULES).collect()}
    assert got == {i: plain_verdict(u, queries.RULES) for i, u in enumerate(urls)}
    assert filter_urls(df.filter(F.lit(False)), queries.RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(df, []).collect()} == {"allow"}


def test_url_query_has_the_verdicts_of_its_contract(spark, tmp_path):
    """Rules and verdicts written out here, apart from the code's list: each rule's own word, nested rules, no rule."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://WWW.Example.net/de/81?q": ("example.net/de/8", "block"), "http://q.org/es/": ("org/es/", "block"), "http://q.org/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op1_url_filters(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_automaton_wildcards_and_many_words():
    globs = ["*.a?c/**", "**z", "x*y", "q" * 130 + "*"] + [f"*.h{i}.org/p/**" for i in range(60)]
    urls = [b".abc/1/2", b".d.abc/", b".abc", b"foo/z", b"xay", b"xa/y", b"q" * 131, b"q" * 129, b".s.h59.org/p/", b".h7.org/q", b""]
    auto = Automaton(globs)
    assert auto.words > 3
    state = auto.run(urls)
    for i, glob in enumerate(globs):
        pattern = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", glob)).encode(), re.S)
        assert auto.accepts(state, i).tolist() == [bool(pattern.fullmatch(u)) for u in urls], glob


def test_rules_longest_wins(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/en/7")], "page_id long, url string")
    assert filter_urls(df, [Rule("com", "/", "block"), Rule("example.com", "/en/", "allow")]).first()["verdict"] == "allow"


# --- 2: quality


def test_quality_equals_direct_fit_and_holds_out(spark, docs, hard, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in rows_of(docs)}
    moments = {}
    for c in (0, 1):
        own = np.array([x[i] for i, q in known.items() if q == c and not out(i)])
        moments[c] = (len(own), own.sum(axis=0), own.T @ own)
    model = quality.Discriminant.fit(moments, 0.1, 0.02)
    for i, v in x.items():
        assert got[i]["held_out"] == out(i)
        assert abs(got[i]["score"] - model.score(v[None])[0]) < 1e-6
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    tested = [(q, got[i]["predicted"]) for i, q in known.items() if out(i)]
    assert np.mean([a == b for a, b in tested]) > 0.8
    away = lambda c: language_id.held_out(c, 5, 0)
    some = spark.createDataFrame([(1, 1), (2, 0), (5, None), (99, 1)], "doc_id long, quality int")
    scored = quality.score_quality(hard, some, away).collect()
    assert len(scored) == len(HARD) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score_quality(empty, labels, away).count() == 0
    assert {r["score"] for r in quality.score_quality(hard, labels.filter(F.lit(False)), away).collect()} == {0.5}


# --- 3: near duplicates


def shingle_set(text):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}, sets


def mutated(rng, words, k):
    words = list(words)
    for i in rng.integers(0, len(words), k):
        words[i] = f"m{rng.integers(0, 10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark, docs, hard, empty):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows = rows_of(docs) + [(10000 + i, mutated(rng, base, int(rng.integers(0, 9)))) for i in range(150)] + [(20000 + i, "same words in every single copy") for i in range(40)]
    rows += [(30000 + i, "shared " * 3 + " ".join(base[:12]) + " " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(60)]
    want, sets = plain_components(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    found = near_duplicates(hard).collect()
    assert len(found) == len(HARD)
    by = {r["doc_id"]: r for r in found}
    assert by[2]["component_id"] == 1 and by[6]["component_id"] == 5 and by[3]["n_shingles"] == 0 and by[4]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_duplicates(empty).count() == 0


def test_large_leaves_are_compared_in_blocks(spark):
    from quakeframe.llm.near_dedup import Plan

    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, mutated(rng, base, int(rng.integers(0, 5)))) for i in range(120)]
    want, _ = plain_components(rows)
    plan = Plan(small=16, depth=1, block_docs=20, block_shingles=1 << 20)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()} == want


def varied(rng, words, keep):
    """A copy that keeps each word run of a base with a chance, so that its shingles and the base's have a known overlap."""
    return " ".join(w if rng.random() < keep else f"n{rng.integers(0, 10**9)}" for w in words)


def test_thousands_of_near_copies_stay_linear(spark):
    from quakeframe.llm import near_dedup

    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, varied(rng, base, 0.99)) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    plan = near_dedup.Plan(small=128, block_docs=256, block_shingles=1 << 15)
    base_rows = near_dedup.describe(docs, plan)
    classes = near_dedup.materialise(base_rows.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")))
    members, absorbed = near_dedup.leaves(classes, plan)
    assert members.count() + absorbed.count() < 2 * 2 * plan.trees * classes.count(), "a few rows for each member and tree"
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, plan).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    whole = Counter(got.values())
    # against the most central text most are linked directly; what is alone must be far from everything
    alone = [i for i, c in got.items() if whole[c] == 1]
    for i in alone:
        assert all(100 * len(sets[i] & s) < 75 * len(sets[i] | s) for j, s in sets.items() if j != i)
    assert whole.most_common(1)[0][1] > 4000


@pytest.mark.parametrize("small", [1024, 64])
def test_recall_at_the_threshold(spark, small):
    """Pairs at exactly 0.75: 48 common and 8 own shingles on each side; linked but for 1 in 1,000 at most."""
    rng = np.random.default_rng(small)
    rows, pairs = [], 1500
    for p in range(pairs):
        common = [f"c{p}x{i}" for i in range(52)]
        rows.append((2 * p, " ".join([*common, *[f"l{p}x{i}" for i in range(8)]])))
        rows.append((2 * p + 1, " ".join([*common, *[f"r{p}x{i}" for i in range(8)]])))
    base = [f"b{i}" for i in range(150)]
    rows += [(10**6 + i, varied(rng, base, 0.985)) for i in range(1500)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), queries_plan(small)).collect()}
    linked = sum(got[2 * p] == got[2 * p + 1] == 2 * p for p in range(pairs))
    assert linked >= 0.999 * pairs
    assert all(got[2 * p] == 2 * p and got[2 * p + 1] in (2 * p, 2 * p + 1) for p in range(pairs))


def queries_plan(small):
    from quakeframe.llm.near_dedup import Plan

    return Plan(small=small)


def test_all_pairs_of_a_leaf_are_confirmed_without_slack_limit(spark, docs):
    from quakeframe.llm.near_dedup import Plan

    plan = Plan(deviations=float("inf"))
    assert plan.floor == 0 and Plan().floor == 34
    rows = rows_of(docs)
    want, _ = plain_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, plan).collect()} == want


def test_no_pair_between_absorbed_groups_is_lost(spark):
    """Families around several centres of one node, with links that run only between the families."""
    from quakeframe.llm.near_dedup import Plan

    rng = np.random.default_rng(13)
    shared = [f"s{i}" for i in range(70)]
    bases = [[*shared, *[f"f{k}x{i}" for i in range(22)]] for k in range(3)]
    rows = [(1000 * k + i, mutated(rng, b, int(rng.integers(0, 5)))) for k, b in enumerate(bases) for i in range(90)]
    rows += [(9000 + i, mutated(rng, [*shared, *bases[0][70:81], *bases[1][81:]], 1)) for i in range(6)]
    want, _ = plain_components(rows)
    plan = Plan(small=16, block_docs=20, block_shingles=1 << 11, deviations=6.0)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()}
    assert got == want


def test_two_texts_of_one_id_keep_all_links(spark):
    base = [f"b{i}" for i in range(60)]
    other = [f"o{i}" for i in range(60)]
    rows = [(7, " ".join(base)), (7, " ".join(other)), (9, " ".join([*other[:-1], "x"])), (8, " ".join([*base[:-1], "y"])), (10, "far from all of these texts")]
    for part in (1, 5):
        got = Counter((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(part)).collect())
        assert got == Counter({(7, 7): 2, (8, 7): 1, (9, 7): 1, (10, 10): 1})


# --- 4: mixing


def plain_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, excess = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while open_ and excess > 1e-9:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / whole
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        excess = sum(target[s] - 2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_mix_meets_targets(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes, taken = Counter(), Counter()
    for r in df.select("source", "text").collect():
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    target = plain_targets(dict(sizes))
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert all(0 <= p["position"] <= 1 for p in r["parts"])
    assert all(taken[s] == int(target[s] + 1e-9) for s in sizes)


def test_mixed_documents_are_whole_and_ordered(docs, hard, empty):
    parts = {}
    for r in mixing.mix(docs).collect():
        parts[r["doc_id"]] = [p["words"] for p in r["parts"]]
    mixed = defaultdict(list)
    for i, text in rows_of(mixing.mix_documents(docs)):
        mixed[i].append(len(WORDS.findall(text)))
    assert {i: sorted(v) for i, v in mixed.items()} == {i: sorted(v) for i, v in parts.items() if v}
    assert mixing.mix_documents(hard).columns == hard.columns
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# --- 5: languages


def test_language_held_out_accuracy_and_hard_rows(spark, docs, hard, empty):
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = queries.op5_language_id(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.95
    filters = language_id.learn(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(hard, filters).collect()}
    assert found[3] == found[4] == found[7] == "und" and {found[1], found[10]} <= set(filters.languages)
    assert language_id.identify(empty, filters).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(hard, language_id.learn(empty)).collect()} == {"und"}


def plain_grams(text):
    """All 4-byte grams of the lower-cased text with runs of other bytes than letters as one space, a space at both ends."""
    lowered = (text if text.isascii() else text.lower()).encode()
    kept = " ".join(re.findall(r"[a-z\x80-\xff]+", lowered.decode("latin-1").translate(LOW)))
    data = f" {kept} ".encode("latin-1") if kept else b" "
    return [data[i : i + 4] for i in range(len(data) - 3)]


def plain_language(text, members, first):
    if text is None or not any(c.isalpha() for c in text):
        return {"und"}, 0.0
    found = plain_grams(text)
    share = {x: sum(g in members[x] for g in found) / max(len(found), 1) for x in sorted(members)}
    if not sum(share.values()):
        return {first}, 0.0
    best = max(share.values())
    return {x for x in share if share[x] > best - 0.01}, best / sum(share.values())


@pytest.mark.parametrize("purity", [0.0, 0.25])
def test_language_equals_plain_sets_of_grams(spark, docs, hard, purity):
    train = docs.filter(~language_id.held_out(F.col("doc_id"), 3, 1))
    counts = defaultdict(Counter)
    for r in train.select("lang", "text").collect():
        if r["lang"] is not None:
            counts[r["lang"]].update(plain_grams(r["text"] or ""))
    share = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    members = {x: {g for g, v in s.items() if v >= purity * top[g]} for x, s in share.items()}
    assert set().union(*members.values()) == set(top), "every n-gram is in one language at least"
    first = max(sorted(counts), key=lambda x: counts[x].total())
    filters = language_id.learn(train, levels=(purity,))
    assert filters.languages == sorted(members)
    for df in (docs, hard):
        for r in language_id.identify(df.select("doc_id", "text"), filters).collect():
            want, score = plain_language(r["text"], members, first)
            assert abs(r["score"] - score) < 0.01
            assert r["lang_pred"] in want, r["doc_id"]


def test_filters_hold_all_members_and_few_others(spark):
    rng = np.random.default_rng(1)
    members = {f"l{i:02d}": rng.integers(0, 1 << 32, 3000) for i in range(70)}
    rows = [(x, int(g)) for x, v in members.items() for g in v]
    found = language_id.filter_bits(spark.createDataFrame(rows, "lang string, gram long"), 18).toPandas()
    names = sorted(members)
    owner = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
    f = language_id.Filters.of_bits(names, "l00", 18, owner, found["word"].to_numpy(dtype=np.int64), found["bits"].to_numpy(dtype=np.int64))
    for i, name in enumerate(names):
        bit = f.languages_of(members[name])[:, i // 8] >> np.uint8(i % 8) & np.uint8(1)
        assert bit.all()
    other = f.languages_of(rng.integers(0, 1 << 32, 20000))[:, 0] & np.uint8(1)
    assert abs(other.mean() - f.false_rate[0]) < 0.002


def test_full_filters_decide_nothing(spark):
    rng = np.random.default_rng(7)
    text = bytes(rng.integers(97, 123, 200_000).astype(np.uint8)).decode()
    train = spark.createDataFrame([("a", text), ("b", text[::-1])], "lang string, text string")
    filters = language_id.learn(train, most_log2=7)
    assert (filters.false_rate == 1).all()
    found = filters.decide([b"some words", b"", b"12"])
    assert [x for _, x in found] == [0.0, 0.0, 0.0] and found[0][0] in ("a", "b")


# --- 6: media


def test_media_round_trip_and_feature(spark, hard, empty):
    text = {(r["doc_id"], r["text"]) for r in hard.collect()}
    got = media.describe_media(media.store_pcm(media.encode_media(hard, "mulaw"))).collect()
    want = Counter()
    for i, t in [(r[0], r[1]) for r in HARD]:
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        want[(i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want and len(text)
    same = {r["payload_sha256"]: (r["media_sha256"], r["feature"]) for r in got}
    assert all(same[r["payload_sha256"]] == (r["media_sha256"], r["feature"]) for r in got)
    assert media.describe_media(media.store_pcm(media.encode_media(empty))).count() == 0
    for kind in media.FORMATS:
        files = [r["media"] for r in media.encode_media(hard, kind).collect()]
        assert all(media.read_wav(f)[3].startswith((t[1] or "").encode()) for f, t in zip(files, HARD, strict=True))
        pcm = media.store_pcm(media.encode_media(hard, kind)).first()["pcm"]
        assert media.read_wav(pcm)[:2] == (media.PCM, 16000)


def plain_mulaw(byte):
    byte = ~byte & 255
    size = (((byte & 15) << 3) + 132 << (byte >> 4 & 7)) - 132
    return -size if byte & 128 else size


def plain_alaw(byte):
    byte ^= 0x55
    exponent, size = byte >> 4 & 7, (byte & 15) << 4
    size = size + 8 if exponent == 0 else size + 264 << exponent - 1
    return size if byte & 128 else -size


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def plain_wav(payload, kind, rate, extra, bits, block):
    head = kind.to_bytes(2, "little") + (1).to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * bits // 8).to_bytes(4, "little") + block.to_bytes(2, "little") + bits.to_bytes(2, "little") + extra
    body = b"WAVEfmt " + len(head).to_bytes(4, "little") + head + b"data" + len(payload).to_bytes(4, "little") + payload
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def test_media_query_equals_plain_python(spark):
    """All digests and features by loops over bytes: tables, ADPCM, linear interpolation to twice the rate, files."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op6_media_columns(spark, SF).collect()}
    assert len(got) == len(docs)
    level = lambda x: [sum(v * v for v in x), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))]
    for r in [r for r in docs if len(r["text"] or "") < 4000][:40]:
        data = (r["text"] or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        one = [plain_mulaw(b) for b in payload]
        steps = [v for at in range(0, len(payload), 192) for v in plain_adpcm(payload[at : at + 192])]
        double = [v for a, b in zip(one, one[1:] + one[-1:]) for v in (a, (a + b) // 2)]
        samples = b"".join(v.to_bytes(2, "little", signed=True) for v in double)
        wav, pcm = plain_wav(payload, 7, 8000, b"\0\0", 8, 1), plain_wav(samples, 1, 16000, b"", 16, 2)
        row = got[r["doc_id"]]
        marks = [*level(one), *level([plain_alaw(b) for b in payload]), *level(steps), *level(double), 16000, zlib.crc32(samples)]
        assert row["feature"] == " ".join(map(str, marks))
        assert (row["media_bytes"], row["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert (row["pcm_bytes"], row["pcm_sha256"]) == (len(pcm), hashlib.sha256(pcm).hexdigest())


def test_resampling_by_any_ratio():
    x = np.array([0, 100, -7, 32767, -32768], dtype=np.int16)
    for up, down in ((1, 1), (2, 1), (441, 320), (3, 4), (1, 3)):
        got = media.resample(x, up, down).tolist()
        wide = [*x.tolist(), int(x[-1])]
        assert got == [(wide[i * down // up] * (up - i * down % up) + wide[i * down // up + 1] * (i * down % up)) // up for i in range(-(-len(x) * up // down))]


def test_lifted_samples_come_back():
    rng = np.random.default_rng(6)
    for n in [*range(9), 1000, 1001]:
        for x in (rng.integers(-32768, 32768, n), rng.choice([-32768, 32767], n)):
            x = x.astype(np.int16)
            assert media.unlift(media.lift(x)).tolist() == x.tolist()
            file = media.pcm_file(x, 8000, 2, 1, lifted=True)
            assert media.restore_pcm(file) == media.restore_pcm(media.restore_pcm(file)) == media.pcm_file(x, 8000, 2, 1)
    assert media.lift(media.resample(np.array([5, -8, 300], dtype=np.int16))).tolist() == [5, -8, 300, 0, 0, 0]


def test_media_query_stores_all_samples_within_its_disk(spark, hard, monkeypatch):
    """Whole PCM files come back from what the query writes, in at most 1.5 times the bytes of its input."""
    sf, tables, write = "/root/testdata/sf0.01", [], media.materialise
    monkeypatch.setattr(media, "materialise", lambda df, **options: tables.append(write(df, **options)) or tables[-1])
    docs = {r["doc_id"]: r for r in queries.op6_media_columns(spark, sf).collect()}
    assert sum(os.path.getsize(unquote(urlparse(f).path)) for f in tables[0].inputFiles()) <= 1.5 * os.path.getsize(f"{sf}/documents.parquet")
    stored = tables[0].collect()
    assert len(stored) == len(docs) and len(tables) == 1
    for r in stored:
        pcm = media.restore_pcm(bytes(r["pcm"]))
        assert pcm == media.pcm_file(*media.decode_wav(bytes(r["media"])), 2, 1) and hashlib.sha256(pcm).hexdigest() == docs[r["doc_id"]]["pcm_sha256"]
    for up, down in ((1, 1), (2, 1), (441, 320), (1, 3)):
        made = [media.describe_media(media.store_pcm(media.encode_media(hard, "adpcm"), up=up, down=down, lifted=lifted)).collect() for lifted in (False, True)]
        assert Counter(made[0]) == Counter(made[1])


def test_tables_and_adpcm_equal_plain_decoding():
    assert media.MULAW_PCM[0] == -32124 and media.MULAW_PCM[255] == 0 and media.MULAW_PCM[128] == 32124
    assert media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x2A] == -32256
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 192 * 5).astype(np.uint8)
    got = media.decode_adpcm(data)
    for b in range(5):
        block = data[b * 192 : (b + 1) * 192].tolist()
        value = block[0] | block[1] << 8
        value -= 65536 if value > 32767 else 0
        index, out = min(block[2], 88), [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                move = step >> 3
                move += step if code & 4 else 0
                move += step >> 1 if code & 2 else 0
                move += step >> 2 if code & 1 else 0
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(media.INDEX_MOVES[code & 7])))
                out.append(value)
        assert got[b].tolist() == out


# --- 7: exact top-k


def plain_top(rows, k=5):
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for q in v:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out.update({(q, n + 1): (c, -s) for n, (s, c) in enumerate(scored[:k])})
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (350, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, [1e6] * 8), (None, [1.0] * 8), (306, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=3, lane_blocks=2).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == plain_top(rows)
    assert exact_topk.top_k(df.filter(F.lit(False)), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_topk.top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1


def test_empty_vectors_score_nothing(spark):
    rows = [(0, []), (1, []), (2, []), (50, [1.0, 2.0]), (51, [0.5, 1.0]), (100, [])]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == plain_top(rows)


def test_large_components_are_multiplied_exactly(spark):
    rng = np.random.default_rng(14)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-2, 5)).tolist()) for i in range(120)]
    rows += [(200 + i, (rng.normal(size=4) * 10.0 ** rng.integers(5, 30)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("clash").alias("score"), F.lit("clash").alias("rank"))
    got = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=32, query_rows=3).collect()
    whole = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = {}
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-held(sum(a * b for a, b in zip(whole[q], whole[c], strict=True))), c) for c in whole if c != q)
        want.update({(q, n + 1): (c, -s) for n, (s, c) in enumerate(scored[:5])})
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_copies_of_a_vector_tie_to_smaller_ids(spark):
    rng = np.random.default_rng(16)
    one, two = rng.normal(size=6).tolist(), rng.normal(size=6).tolist()
    rows = [(i, one if i % 3 else rng.normal(size=6).tolist()) for i in range(40, 400)] + [(i, two) for i in (400, 401, 450)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=32, query_rows=3).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == plain_top(rows)
    whole = exact_topk.whole_vectors(df.unionByName(df), F.col("vec_id") % 50 == 0, 256)
    fewer = exact_topk.without_beaten_copies(whole, 5)
    assert fewer.groupBy("v").count().agg(F.max("count")).first()[0] == 12  # six ids, two rows each
    repeated = exact_topk.top_k(df.unionByName(df), F.col("vec_id") % 50 == 0, block_rows=32).groupBy("query_id").count()
    assert {r["count"] for r in repeated.collect()} == {10}


def test_repeated_query_rows_have_results_of_their_own(spark):
    rows = [(50, [1.0]), (50, [1.0])] + [(i, [float(i)]) for i in range(1, 9)]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == sorted((n + 1, i) for n, i in enumerate((8, 7, 6, 5, 4)) for _ in range(2))


def test_bounds_leave_few_vectors_open():
    rng = np.random.default_rng(15)
    block = np.floor(256 * rng.normal(size=(2048, 64)) / 8)
    lower, upper = exact_topk.Approximation.of(block).bounds(block[:40])
    x, _ = exact_topk.open_pairs(np.arange(40), np.arange(2048), lower, upper, 5)
    assert len(x) < 40 * 64


def test_bounds_hold():
    rng = np.random.default_rng(6)
    block, queries_ = rng.integers(-300, 300, (500, 16)).astype(float), rng.integers(-300, 300, (20, 16)).astype(float)
    low, high = exact_topk.Approximation.of(block).bounds(queries_)
    true = queries_ @ block.T
    assert (low <= true).all() and (true <= high).all()


# --- 8: sharding


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    df = spark.range(side**dims).select(*[((F.col("id") / side**d).cast("long") % side).cast("int").alias(f"d{d}") for d in range(dims)])
    rows = df.withColumn("h", sharding.hilbert_index([F.col(f"d{d}") for d in range(dims)], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(side**dims))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[f"d{d}"] - b[f"d{d}"]) for d in range(dims)) == 1


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_shards_are_even_gapless_runs(which, request):
    df = request.getfixturevalue(which)
    got = sharding.shard_documents(df).collect()
    assert len(got) == df.count()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    slots, cells = defaultdict(list), defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        cells[r["shard"]].append(r["cell"])
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    edges = [x for s in sorted(cells) for x in (min(cells[s]), max(cells[s]))]
    assert edges == sorted(edges)


def test_no_shards_of_nothing(empty):
    assert sharding.shard_documents(empty).count() == 0


# --- 9: line dedup


def plain_lines(rows, least, keep_first=False):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, ls in lines for k in {key(x) for x in ls} if k)
    seen, out = set(), {}
    for place in sorted(range(len(lines)), key=lambda p: (lines[p][0] is not None, lines[p][0] or 0)):
        i, ls = lines[place]
        kept = []
        for x in ls:
            k = key(x)
            first = keep_first and k not in seen
            seen.add(k)
            if not k or n[k] < least or first:
                kept.append(x)
        out[place] = (i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return Counter(out.values())


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup_equals_brute_force(spark, docs, keep_first):
    rows = rows_of(docs) + [(5000 + i, "\n".join([" Common LINE\t", f"own {i}", "", "common line"] + [f"l{j}" for j in range(70 + i)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.digest(line_dedup.dedup_lines(df, min_docs=10, keep_first=keep_first)).collect()
    assert Counter(map(tuple, got)) == plain_lines(rows, 10, keep_first)


def test_line_dedup_hard_rows(hard, empty):
    got = line_dedup.digest(line_dedup.dedup_lines(hard, min_docs=2)).collect()
    assert Counter(map(tuple, got)) == plain_lines([(r[0], r[1]) for r in HARD], 2)
    assert line_dedup.dedup_lines(empty).count() == 0


# --- 10: SentencePiece


def test_pieces_equal_the_library_and_cover_the_text(hard, empty, docs):
    model = queries.piece_model()
    for df in (hard, docs.limit(50)):
        rows = rows_of(df)
        encoded = sentencepiece_codec.encode_documents(df, model)
        got = sentencepiece_codec.digest(sentencepiece_codec.decode_documents(encoded, model)).collect()
        want = sentencepiece_codec.reference_digest([t for _, t in rows], model)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
        for r in encoded.select("text", "ids", "span_begin", "span_end").collect():
            data = (r["text"] or "").encode()
            assert r["span_end"][-1] == len(data) and (len(r["ids"]) == 1 or r["span_begin"][0] == 0)
            assert all(a <= b for a, b in zip(r["span_begin"], r["span_end"], strict=True))
    assert sentencepiece_codec.encode_documents(empty, model).count() == 0


def test_normaliser_replaces_longest_prefix_and_keeps_alignment():
    rules = {b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"\t": b" ", "ﬁ".encode(): b"fi"}
    table = sentencepiece_codec.CharacterMap.build(rules)
    for source, target in rules.items():
        assert table.longest(source + b"?", 0) == (len(source), target)
    assert table.longest(b"a?", 0) is None and table.longest(b"abd", 0) == (2, b"X")
    run = sentencepiece_codec.Normaliser(table, True, True, True)
    text = "  abc\té ﬁn  ".encode()
    out, align = run(text)
    assert out.decode() == "▁YY▁e▁fin" and len(out) == len(align)
    assert align[-1] == text.rindex(b"n") and (np.diff(align) >= 0).all()
    assert run(b"   ")[0] == b"" and run(b"\xff")[0].decode() == "▁�"
