"""The ten operators against brute force, round trips and held-out accuracy; and on nulls, empty, long, tied and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from plasmaspark.llm import byte_bpe, chat, components, exact_dedup, langid, merkle, near_dup, packing, pii, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, very long and repeated texts, repeated rows, and an extra column with a clashing name."""
    rows = [(1, "a b c d e", "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x y", "fr", "s", 3), (5, LONG, "en", "s", len(LONG)), (6, "a b c d e", "en", "s", 9), (6, "a b c d e", "en", "s", 9), (8, "é\n\nü <|im_end|> 1.2.3.4", "de", "s", 23), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("text_sha256", F.lit("mine")).withColumn("code", F.lit(7)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 toxicity ----


def _toxic_rows(n: int, seed: int):
    rng = random.Random(seed)
    plain, bad = [f"w{i}x" for i in range(300)], ["nastyword", "vilething", "grimstuff"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                words[rng.randrange(60)] = w
        rows.append((i, " ".join(words), toxic))
    return rows


def test_chain_finds_held_out_toxic_texts(spark):
    rows = _toxic_rows(800, 1)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows if i < 400], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.toxic for r in toxicity.rejected(docs, labels).collect()}
    wrong = [i for i, _, x in rows if i >= 400 and found[i] != x]
    assert len(wrong) <= 4
    assert {r.doc_id for r in toxicity.clean(docs, labels).collect()} == {i for i, r in found.items() if not r}


def test_later_models_see_out_of_fold_predictions():
    rows = _toxic_rows(600, 2)
    lists, y = [toxicity.features(t) for _, t, _ in rows], np.array([x for *_, x in rows])
    leads = toxicity.lead_features(lists[:200], y[:200])
    labels = toxicity.categories(leads, lists[200:], y[200:])
    assert list(labels) == ["kind_1", "kind_2", "kind_3", "toxic"]
    kinds = [labels[c] for c in list(labels)[:-1]]
    assert all(0.2 < (a & b).sum() / a.sum() < 0.8 for i, a in enumerate(kinds) for b in kinds[:i])  # two of three words each: kinds overlap by half
    chain = toxicity.fit_chain(lists[200:], labels)
    assert [len(m.chain) for _, m in chain] == [0, 1, 2, 3]
    # the predictions that later models were given are the folds' own
    n, fold = 400, np.arange(400) % toxicity.FOLDS
    flat = lambda keep: (np.repeat(np.arange(keep.sum()), [len(x) for x, k in zip(lists[200:], keep, strict=True) if k]), np.concatenate([x for x, k in zip(lists[200:], keep, strict=True) if k]))
    seen = np.zeros((n, 1))
    for k in range(toxicity.FOLDS):
        first = toxicity._fit(*flat(fold != k), np.zeros(((fold != k).sum(), 0)), labels["kind_1"][fold != k].astype(float))
        seen[fold == k, 0] = toxicity._apply(first, *flat(fold == k), np.zeros(((fold == k).sum(), 0)))
    second = toxicity._fit(*flat(np.ones(n, bool)), seen, labels["kind_2"].astype(float))
    assert np.allclose(second.weights, chain[1][1].weights) and np.allclose(second.chain, chain[1][1].chain)


def test_chain_on_the_labelled_table(spark):
    import duckdb

    known = duckdb.sql("SELECT doc_id, any_value(text), max(toxic) FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) GROUP BY doc_id ORDER BY doc_id").fetchall()
    half = [(i, 1, t) for n, (i, _, t) in enumerate(known) if n % 2]
    rest = {i: bool(t) for n, (i, _, t) in enumerate(known) if not n % 2}
    docs = spark.createDataFrame([(i, t) for i, t, _ in known], "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.toxic for r in toxicity.rejected(docs, spark.createDataFrame(half, "doc_id long, quality int, toxic int")).collect()}
    toxic = [i for i, t in rest.items() if t]
    assert sum(found[i] for i in toxic) >= 0.85 * len(toxic)
    assert sum(found[i] for i, t in rest.items() if not t) <= 0.01 * len(rest)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.rejected(odd, labels).count() == odd.count()
    assert toxicity.clean(odd, labels).columns == odd.columns
    assert toxicity.rejected(none, labels.limit(0)).count() == 0
    rows = [(i, t, "en", "s", 0) for i, t, _ in _toxic_rows(400, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("p_toxic", F.lit("mine"))
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, known)
    scored = toxicity.classify(docs, chain)
    assert dict(scored.dtypes)["p_toxic"] == "double" and scored.columns.count("p_toxic") == 1
    assert toxicity.clean(docs, known).where("p_toxic = 'mine'").count() == 320


# ---- 2 exact dedup ----


def test_trie_holds_what_was_inserted():
    rng = random.Random(1)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(2000)]
    trie = exact_dedup.PatriciaTrie()
    for k in keys:
        t = trie.terminal(k)
        t.append(k)
    assert sorted((t[0], len(t)) for t in trie.terminals()) == sorted({(k, keys.count(k)) for k in keys})
    assert all(len(set(t)) == 1 for t in trie.terminals())


@pytest.mark.parametrize("budget", [1, 200, exact_dedup.BUDGET])
def test_membership_is_brute_force(spark, budget):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", "a", "ab", "abc", "b" * 50, None, f"only {i}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.membership(docs, budget=budget).collect()}
    assert got == want
    assert sorted(r.doc_id for r in exact_dedup.survivors(docs, budget=budget).collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_of_odd_rows(odd, none):
    rows = exact_dedup.membership(odd).collect()
    assert len(rows) == 9 and sum(r.kept for r in rows) == 5
    assert {r.keep_id for r in rows if r.doc_id in (2, 3, None)} >= {3}
    kept = exact_dedup.survivors(odd)
    assert kept.columns == [*odd.columns, "group_size"] and kept.count() == 5
    again = exact_dedup.survivors(odd.withColumn("group_size", F.lit("mine")))
    assert again.columns == [*odd.columns, "group_size"] and again.agg(F.sum("group_size")).first()[0] == 9
    assert exact_dedup.membership(none).count() == 0


# ---- 3 SimHash ----


def _slow_fingerprint(text: str, n: int) -> int:
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", "one", "A b C d É É f", "x " * 50, "a b c\x1cd\te\x0bf g"):
        assert simhash.fingerprint(text, 4) == _slow_fingerprint(text, 4)


def _sets(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("k", "crowded"), [(4, 20_000), (4, 8), (10, 20_000)])
def test_index_links_like_all_pairs(spark, k, crowded):
    rng = np.random.default_rng(1)
    codes = [0]
    for base in rng.integers(0, 1 << 63, 12, dtype=np.uint64):
        for _ in range(120):
            x = int(base)
            for _ in range(int(rng.integers(0, 7))):
                x ^= 1 << int(rng.integers(64))
            codes.append(x)
    codes = np.unique(np.array(codes, np.uint64))
    near = [(i, int(j) + i + 1) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= k)]
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    df = spark.createDataFrame([(c,) for c in place], "code long")
    found = [(place[r.a], place[r.b]) for r in simhash.near_links(df, k, crowded).collect()]
    assert set(map(tuple, map(sorted, found))) <= set(near)
    assert _sets(len(codes), found) == _sets(len(codes), near)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)]
    want = {i: r for i, r in enumerate(_sets(500, links)) if i != r}
    got = {r.node: r.root for r in components.stars(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == want


def test_near_copies_go_and_clean_ones_stay(spark, odd, none):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(100, 150)] + [(1, " ".join(base))]
    for i in range(2, 8):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dup.thinned(docs).collect()) == [1, *range(100, 150)]
    got = simhash.classes(odd)
    assert got.count() == 9
    assert {r.component_id for r in got.where("doc_id in (2, 3)").collect()} == {2}
    assert simhash.classes(none).count() == 0 and near_dup.thinned(none).count() == 0
    kept = near_dup.thinned(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 5, 8]


def _sets_of(texts: list[str], n: int = 5) -> list[set]:
    words = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in words]


@pytest.mark.parametrize(("budget", "members", "size"), [(4, 20_000, 10**7), (1, 20_000, 10**7), (1, 30, 2000)])
def test_near_duplicates_are_brute_force(spark, budget, members, size):
    # families whose members are alike or not quite, chains, and texts on their own
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for share in (0.005, 0.015, 0.02, 0.03, 0.04):
        base = [word() for _ in range(120)]
        texts += [" ".join(word() if rng.random() < share else w for w in base) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[i * 15 : i * 15 + 150]) for i in range(4)]
    sets = _sets_of(texts)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = [tuple(r) for r in near_dup.links(docs, budget=budget, members=members, size=size).collect()]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in pairs}
    want, got = _sets(len(texts), pairs), _sets(len(texts), found)
    missed = [i for i, j in pairs if got[i] != got[j]]
    assert len(missed) <= 0.02 * len(pairs) and sum(a != b for a, b in zip(want, got, strict=True)) <= 0.05 * len(texts)
    assert len(found) < len(pairs) / 2 or budget > 1


def test_wide_codes_are_majorities():
    sets = [near_dup.shingles(t, 5) for t in ("", "a", LONG, "A b C d e f g", " ".join(f"x{i}" for i in range(3000)))]
    for own, code in zip(sets, near_dup.codes(sets), strict=True):
        bits = [near_dup.mixed(own + np.uint64(near_dup.ODD * (w + 1) % 2**64)) for w in range(near_dup.WIDTH)]
        assert [int(c) for c in code] == [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in w) > len(own)) for w in bits]
    assert list(near_dup.shingles("A b C d e f", 5)) == list(near_dup.shingles("a B\tc  d e f", 5)) and len(near_dup.shingles(LONG, 5)) == 3


def test_masks_keep_recall_at_any_size():
    for n in (10, 10**6, 10**9, 4 * 10**10):
        under = near_dup.masks(n, 0.8)
        bits = {sum(int(x).bit_count() for x in m) for m in under}
        (width,) = bits
        assert n / 2**width <= near_dup.MEMBERS and 1 - (1 - (1 - near_dup.apart(0.8)) ** width) ** len(under) >= near_dup.MEET


def test_long_texts_are_compared_by_all_their_shingles(spark):
    # pairs of 6000 words just below and just above 0.8
    rows, want = [], []
    for n in range(24):
        rng = random.Random(n)
        one = [f"w{rng.randrange(10**9)}" for _ in range(6000)]
        changed = 650 if n % 2 else 680
        two = one[:-changed] + [f"w{rng.randrange(10**9)}" for _ in range(changed)]
        a, b = _sets_of([" ".join(one), " ".join(two)])
        alike = len(a & b) / len(a | b)
        assert 0.79 < alike < 0.81 and (alike >= 0.8) == bool(n % 2)
        rows += [(2 * n, " ".join(one)), (2 * n + 1, " ".join(two))]
        want += [2 * n] if alike >= 0.8 else [2 * n, 2 * n + 1]
    kept = sorted(r.doc_id for r in near_dup.thinned(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(want) <= set(kept) and len(kept) <= len(want) + 3


# ---- 4 byte BPE ----

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pre_tokens_match_the_public_pattern():
    import regex

    rng, whole = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    for _ in range(5000):
        text = "".join(rng.choice([chr(rng.randrange(256)), " ", "'s", "'ll", "\n", "ж", "1", "a"]) for _ in range(rng.randrange(12)))
        assert byte_bpe.pre_tokens(text) == whole.findall(text)


def test_one_set_of_workers_reassembles_and_decodes(spark, odd):
    sent = byte_bpe.encode(odd, RANKS, block_size=5, into="decoded")
    key = lambda r: (str(r.doc_id), r.ids, bytes(r.decoded))
    assert sorted(map(key, sent.collect())) == sorted(map(key, byte_bpe.decode(byte_bpe.encode(odd, RANKS), RANKS).collect()))
    plan = __spark_entry__.queries()["op4_byte_bpe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4  # one after the other in a stage would run beside each other


@pytest.mark.parametrize("block", [5, byte_bpe.BLOCK])
def test_bpe_is_the_librarys_and_round_trips(spark, odd, none, reference_encoding, block):
    coded = byte_bpe.decode(byte_bpe.encode(odd, RANKS, block_size=block), RANKS).collect()
    texts = sorted((r.text or "") for r in odd.collect())
    assert sorted(bytes(r.decoded).decode() for r in coded) == texts
    assert sorted(map(tuple, (r.ids for r in coded))) == sorted(tuple(reference_encoding.encode_ordinary(t)) for t in texts)
    assert byte_bpe.encode(none, RANKS).count() == 0


# ---- 5 language id ----


def test_languages_and_mixtures(spark, odd, none):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "ber", "ung"], "cc": ["eau", "oir", "que"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang := rng.choice(list(syllables)), 40), lang, "s", 0) for i in range(300)]
    models = langid.learn(spark.createDataFrame(rows[:200], SCHEMA))
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows[200:], SCHEMA).select("doc_id", "text"), models).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].languages == [r[2]] for r in rows[200:])
    mixed = spark.createDataFrame([(1, text("aa", 60) + " " + text("cc", 30))], "doc_id long, text string")
    (one,) = langid.predict(mixed, models).collect()
    assert one.languages == ["aa", "cc"] and abs(one.score - 2 / 3) < 0.05
    found = langid.predict(odd.select("doc_id", "text"), models)
    assert found.count() == 9 and {r.lang_pred for r in found.where("doc_id in (2, 3)").collect()} == {"und"}
    assert langid.predict(odd.withColumn("score", F.lit("mine")), models).where("score > 1").count() == 0
    assert langid.learn(none) is None
    assert {r.lang_pred for r in langid.predict(odd.select("doc_id", "text"), None).collect()} == {"und"}


def test_inference_of_a_document_is_its_own():
    rng = np.random.default_rng(1)
    sizes = rng.integers(2, 12, 1500)
    logs, n = rng.normal(-20, 8, (sizes.sum(), 4)), rng.integers(1, 9, sizes.sum())
    together, ends = langid.infer(logs, n, sizes), np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        assert np.allclose(langid.infer(logs[a:b], n[a:b], sizes[i : i + 1])[0], together[i])


# ---- 6 personal data ----


def test_base_spans_of_personal_data():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "@", "b.c", ".", "1", "22", "255", ".3", "4444", " ", "-", "+1", "(", "é", "4111111111111111"]) for _ in range(rng.randrange(1, 14)))
        want = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = [int(c) for c in m.group() if c.isdigit()]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
                want.append((m.start(), m.end(), "card"))
        want += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
        assert pii.base_spans(t) == want
    assert pii.base_spans("9" * 200_000 + "a" * 200_000) == []
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(0, 5007, "ip")] and pii.base_spans("1.2.3." + "4" * 5000) == []


def test_trusted_contexts_find_unseen_identifiers(spark, odd, none):
    rows = [(i, f"hello {w} contact mail: user{i}@ex.com bye") for i, w in enumerate("abcdef")] + [(10, "word contact mail: ZX-99812 end"), (11, "the ZX-99812 the x the y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs).collect()}
    assert found[10] == [("found", 19, 27)] and found[11] == [] and found[0] == [("email", 22, 34)]
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[10] == "word contact mail: <found> end" and text[0] == "hello a contact mail: <email> bye"
    assert pii.find(odd).count() == 9 and pii.redact(odd).columns == odd.columns
    assert pii.find(none).count() == 0


def test_candidates_and_contexts_have_any_length(spark):
    long = "x" * 300
    rows = [(i, f"{w} {long} mail: u{i}@ex.com {long}: +49 30 123456{i} bye") for i, w in enumerate("abcdef")]
    rows += [(10, f"call {long} mail: 555 123 4567, then {long}: 12 34 end"), (11, "a1 " * 3 + "k9@ex.com q7 z8"), (12, "1" * 100_000 + "a" * 100_000 + "@" * 1000), (13, f"{'w' * 10**6} " + "a1@b.cd," * 20_000)]
    found = {r.doc_id: [(s.kind, dict(rows)[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[10] == [("found", "555 123 4567"), ("found", "12 34")]
    assert found[11] == [("email", "k9@ex.com")] and found[12] == [] and len(found[13]) == 20_000


def test_pattern_graph_is_brute_force(spark):
    rng = random.Random(9)
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            value = rng.choice([f"u{rng.randrange(9)}@a.bc", "9.9.9.9", f"k{rng.randrange(6)}"])
            words += rng.choice([["the", "no"], ["mail", value], ["mail", "to", value], ["code", f"k{rng.randrange(6)}"], ["at", f"q{rng.randrange(50)}", "x"]])
        docs.append((i, " ".join(words)))
    got = {r.doc_id: sorted((s.start, s.end) for s in r.spans if s.kind == "found") for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # the same by words: instances of patterns, then scores over the rounds
    each, occurs = [], Counter()
    for i, text in docs:
        words = text.split()
        occurs.update((w,) for w in words)
        occurs.update(zip(words, words[1:], strict=False))
        for kind, a, b, value, _ in pii.entities(text):
            before = text[:a].split()
            each.append((i, a, b, value, bool(kind), [tuple(before[-n:]) for n in (1, 2) if len(before) >= n]))
    graph: dict = {}
    for *_, value, seed, patterns in each:
        for p in patterns:
            graph.setdefault(p, []).append((value, seed))
    strong, worth = {}, {}
    for step in range(pii.ROUNDS):
        for p, rows in graph.items():
            values, own = {v for v, s in rows if s or (step and worth.get(v, 0) > 0)}, sum(1.0 if s else worth.get(v, 0) if step else 0 for v, s in rows)
            strong[p] = min(1.0, own / occurs[p]) if len({v for v, _ in rows}) >= pii.SUPPORT and len(values) >= pii.SUPPORT else 0.0
        worth = {}
        for p, rows in graph.items():
            for v, _ in rows:
                if strong[p] >= pii.TRUST:
                    worth[v] = max(worth.get(v, 0), strong[p])
    want: dict = {i: set() for i, _ in docs}
    for i, a, b, _, seed, patterns in each:
        if not seed and any(strong[p] >= pii.TRUST for p in patterns):
            want[i].add((a, b))
    assert {i: sorted(x) for i, x in want.items()} == got and any(got.values())


# ---- 7 Merkle ----


def test_merkle_trees(spark, odd, none):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "c. ", "\n", "\n\n", "é", "!"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = {r.text: r for r in merkle.fingerprints(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), "text").join(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), "doc_id").collect()}
    assert len({r.root for r in rows.values()}) == len({r.fingerprint for r in rows.values()}) == len(set(texts))
    pair = spark.createDataFrame([("one.\ntwo\n\nthree\nfour", "one.\ntwo\n\nthree\nfive\nsix")], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    assert [tuple(x) for x in pair.select(merkle.differing(F.col("a"), F.col("b")).alias("d")).first().d] == [(1, 1), (1, 2)]
    assert pair.select(merkle.differing(F.col("a"), F.col("a")).alias("d")).first().d == []
    assert merkle.edits(none).count() == 0 and merkle.edits(odd).count() == 9
    nulls = spark.createDataFrame([(None, f"t{i}") for i in range(50)] + [(i, f"n{i}") for i in range(50)], "doc_id long, text string")
    assert merkle.edits(nulls).count() == 100
    texts = dict((r.text, r.next_text) for r in merkle.with_next(nulls, "doc_id", ["text"], 8).collect())
    order = [f"n{i}" for i in range(49, -1, -1)] + sorted(f"t{i}" for i in range(50))
    assert texts == dict(zip(order, [*order[1:], order[0]], strict=True))


@pytest.mark.parametrize("n", [1, 2, 150])
def test_edits_use_the_next_document(spark, n):
    rng = random.Random(n)
    rows = {rng.randrange(10**6): "".join(rng.choice("abc. \n") for _ in range(rng.randrange(200))) for _ in range(n)}
    ids = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in merkle.edits(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == set(ids)
    for i, x in enumerate(ids):
        text, following = rows[x], rows[ids[(i + 1) % len(ids)]]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert got[x].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[x].fingerprint == got[x].edited_fingerprint) == (edited == text)
        assert 0 <= got[x].near_edited <= 1 and (text != edited or got[x].near_edited == 1)


# ---- 8 packing ----


@pytest.mark.parametrize("limit", [7, 4096])
def test_packing(spark, odd, none, limit):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    extra = spark.createDataFrame([(49, "<|endoftext|> a<|startoftext|><|endoftext|>b <|EndOfText|>"), (50, "Don't  STOP <|endoftext|> \x1c ž é²x'll"), (51, "İstanbul ﬁ 12"), (52, "naïve café's ¼")], "doc_id long, text string")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").unionAll(extra).collect()}
    rows = packing.pack(docs.select("doc_id", "text").unionAll(extra), path, limit=limit).collect()
    whole: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and r.start == len(whole.setdefault(r.doc_id, []))
        whole[r.doc_id] += ids.tolist()
    assert whole == {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    filled: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n == limit for s, n in filled.items() if s < max(filled))
    assert packing.pack(none, path).count() == 0 and packing.pack(odd, path).where("doc_id IS NULL").count() == 2


# ---- 9 chat ----


def test_turns_round_trip():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice([chat.START, chat.END, "<", "|", "\\", "a", "\n", "<\\|", "%0A"]) for _ in range(rng.randrange(9)))
        role = "".join(rng.choice(["user", "\n", "%", "<", "|"]) for _ in range(rng.randrange(3)))
        out, _ = chat.render(role, text)
        assert [t[:2] for t in chat.parse(out + out)] == [(role, text)] * 2
    assert chat.render("user", "plain")[1] == 0 and chat.render("user", chat.END)[1] == 1
    with pytest.raises(ValueError):
        chat.parse("no turn")


@pytest.mark.parametrize("limit", [10, chat.PART])
def test_conversations(spark, limit):
    rows = [(1, 1, "assistant", "b" * 30), (1, 0, "user", None), (1, 2, "assistant", chat.END), (2, None, None, "x"), (None, 0, "user", "y"), (2, 0, "user", LONG), (2, 0, "user", LONG)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(given, limit=limit)).collect()}
    want = {1: [("user", ""), ("assistant", "b" * 30), ("assistant", chat.END)], 2: [("", "x"), ("user", LONG), ("user", LONG)], None: [("user", "y")]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        under = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(under))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(under.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(given.limit(0))).count() == 0


# ---- 10 secrets ----


def test_base_spans_of_secrets():
    rng, order = random.Random(3), {"assign": 0, "access": 1, "hex": 2}
    name = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    for _ in range(4000):
        t = "".join(rng.choice(["AKIA", "ABCDEFGH12345", "password", "Token", "ſecret", " = ", "'", ":", "deadbeef01234567", "\n", "api_key", "é"]) for _ in range(rng.randrange(1, 14)))
        want = [(m.start(), m.end(), "assign") for m in re.finditer(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(2)) >= 8]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
        assert secrets.base_spans(t) == sorted(want, key=lambda s: (s[0], order[s[2]]))


def test_constants_reach_sensitive_names(spark, odd, none):
    text = "a = 'Zx9!kLmQ22pw'\nb = a\ndb_password = b\ntitle: hello world\ncolor = 'Zx9!kLmQ22px'"
    _, spans = secrets.scan(text)
    assert [(text[a:b], k) for a, b, k in spans] == [("Zx9!kLmQ22pw", "flow")]
    assert secrets.scan("The secret: nothing is here. A token of love, pass = the salt")[1] == []
    assert secrets.scan("=" * 100_000 + "a:" * 50_000)[1] == []
    assert secrets.find(odd).count() == 9 and secrets.find(none).count() == 0


def test_literals_of_any_form_and_length():
    mixed = "".join(random.Random(1).choices("abcXYZ0189!", k=6000))
    for value in ("p@ss;Xw0rd12Kq", "p@ss,{Xw0rd}12Kq", mixed):
        for text in (f'db_credential = "{value}"', f"{'x' * 70}_pwd{' ' * 40}={' ' * 40}'{value}'"):
            _, spans = secrets.scan(text)
            assert [(text[a:b], k) for a, b, k in spans] == [(value, "flow")]
    tag = f"<{'x' * 70}_pwd>{mixed}</{'x' * 70}_pwd>"
    assert ("flow" in {k for *_, k in secrets.scan(tag)[1]}) and secrets.scan("pwd = Ab1;Xw0rd12Kq")[1] == []
    # terms that assignments share, in texts that would take minutes if each read its own
    for text in ("key=a1" * 20_000, "key: b=c + " * 10_000, "key:'" * 40_000, "".join(f"k{i}: k{i + 1}\n" for i in range(20_000)), "a" + " " * 200_000, "a: " + "'x' + " * 30_000):
        secrets.scan(text)


def test_quotes_and_continued_lines():
    for value, quote in ((r"Zx9!kLm\'Q22pw", "'"), (r"Zx9!\"kLmQ22pw", '"'), ("Zx9!kLmQ22pw\\", '"'), ("Zx9!k'Lm\nQ2\"2pw", '"""'), ('Zx9!k"Lm\nQ22pw', "'''"), ("Zx9!k'Lm\nQ22pw", "`")):
        text = f"user = 1\ndb_credential = {quote}{value}{quote}\nmode = fast"
        assert [(text[a:b], k) for a, b, k in secrets.scan(text)[1]] == [(value, "flow")]
    for joint in (" + ", "\n    + ", " + \\\n", " \\\n+ "):
        text = f"b = 'Zx9!kLmQ22pw'\nmy_pwd = 'v1'{joint}b\n"
        assert [(text[a:b], k) for a, b, k in secrets.scan(text)[1]] == [("Zx9!kLmQ22pw", "flow")]
    for text in ('a="""' * 100_000, 'a="""\\"' * 100_000, "a='" * 100_000 + 'a="' * 100_000, "a=`" * 100_001, "a=" * 50_000 + " " * 100_000, 'pwd="' + "\\" * 600_000):
        secrets.scan(text)  # in linear time


def test_names_with_digits_are_references():
    for text in ("s3_raw = 'Zx9!kLmQ22pw'\ndb_credential = s3_raw", "db_credential = key2 + step1\nstep1: v0\nv0 = 'Zx9!kLmQ22pw'"):
        _, spans = secrets.scan(text)
        assert [(text[a:b], k) for a, b, k in spans] == [("Zx9!kLmQ22pw", "flow")]
    text = "db_credential = Zx9kLmQ22pw"  # assigned nowhere
    assert [(text[a:b], k) for a, b, k in secrets.scan(text)[1]] == [("Zx9kLmQ22pw", "flow")]


def test_crc_of_pieces_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"\xff\xff")).alias("c")).first().c == zlib.crc32(b"\xff\xff")
