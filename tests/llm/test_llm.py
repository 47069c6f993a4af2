"""The corpus operators against brute force, exact round trips, held-out accuracy and odd inputs."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline import llm
from weftline.llm import components, decontaminate, embedding_dedup, katz, line_dedup, ngram_join, packing, quality, quote_linking, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en", "web", None if t is None else len(t)) for k, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(1, None, None, None, None), (None, "a b c d e f g", None, None, 13), (2, "", "en", "x", 0), (3, "w " * 60_000, "en", "x", 1), (4, "x" * 120_000, "en", "x", 1), (5, "same text here", "en", "x", 1), (5, "same text here", "en", "x", 1), (6, " \n\t\n", "en", "x", 1), (7, "é☃𝄞 ñandú", "es", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("id", "key", "line", "held_out", "score", "piece", "set_id", "component", "a", "b", "d", "t", "gone", "rank", "text_hash")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def oracle(name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(llm.oracle_sql()[name])
    return sorted(rel.columns), sorted(rel.fetchall(), key=str), rel.columns


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op4_seekable_warc", "op5_embedding_near_dedup"])
def test_oracles(spark, name):
    columns, want, order = oracle(name)
    got = llm.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=str) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(101, 160)} == {100}


def shingles(line):
    return {line[k : k + 5] for k in range(len(line) - 4)}


def brute_lines(rows):
    """First line of each component, by all pairs."""
    lines = [(d, n, x.strip().lower()) for d, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    sets = [shingles(x) for *_, x in lines]
    up = list(range(len(lines)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(lines)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: lines[k][:2])
                up[b] = a
    return {lines[k][:2]: lines[root(k)][:2] for k in range(len(lines))}


def test_line_dedup_equals_brute_force(spark, table):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    base = [" ".join(rng.choice(words, n)) for n in (8, 14, 20, 30, 40, 60) for _ in range(4)]
    texts = []
    for _ in range(12):
        lines = []
        for line in (base[k] for k in rng.choice(len(base), 4)):
            w = line.split()
            if len(w) >= 20:
                w[rng.integers(len(w))] = rng.choice(words)
            lines.append(" ".join(w).title())
        texts.append("\n".join([*lines, "", "}"]))
    rows = list(enumerate(texts))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_dedup.line_components(docs_of(spark, texts)).collect()}
    want = brute_lines(rows)
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)  # bands miss few links
    assert all(got[k] == k for k in want if want[k] == k)  # and nothing is removed that stands alone


def test_line_dedup_links_lines_around_sixteen_characters(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz  "), n)).strip() for n in range(10, 29) for _ in range(8)]
    lines = [y for x in base for y in (x, x[:-1], "q" + x)]
    lines += ["-" * n for n in (5, 15, 16, 30, 80)] + ["- " * n + "-" for n in (3, 7, 8, 40)] + ["ab" * n for n in (6, 9, 60)]
    rows = [(k, "\n".join(lines[k::7])) for k in range(7)]
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_dedup.line_components(docs_of(spark, [t for _, t in rows])).collect()}
    want = brute_lines(rows)
    assert got.keys() == want.keys()
    wrong = {k for k in want if got[k] != want[k]}
    assert len(wrong) <= 0.02 * len(want)
    rules = [k for k in want if set(dict(rows)[k[0]].split("\n")[k[1]]) <= set("- ")]
    assert len(rules) == 9 and not wrong & set(rules)
    assert all(got[k] == k for k in want if want[k] == k)


def test_line_dedup_texts(spark):
    line = "the quick brown fox jumps over the lazy dog by the river bank"
    out = line_dedup.dedup_lines(docs_of(spark, [f"{line}\nalone here with words", line, f"new line of some words\n{line}", "", None, f"{line}\n\n{line}"])).orderBy("doc_id")
    assert [tuple(r)[:2] for r in out.select("doc_id", "text").collect()] == [(0, f"{line}\nalone here with words"), (2, "new line of some words"), (3, ""), (4, None)]
    assert [r[0] for r in out.select("n_chars").collect()][1] == len("new line of some words")


def test_ngram_join_finds_near_copies(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    near = [*base[:100], "changed", *base[101:]]
    far = [f"v{k}" for k in rng.integers(0, 5000, 300)]
    kept = ngram_join.keep_one(docs_of(spark, [" ".join(x) for x in (base, near, far, base)] + ["", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    item = [f"q{k}" for k in rng.integers(0, 9000, 40)]
    swapped = [x if k % 9 else "zzz" for k, x in enumerate(item)]
    plain = [f"p{k}" for k in rng.integers(0, 9000, 40)]
    docs = docs_of(spark, [" ".join(["start", *item, "end"]), " ".join(["x", *swapped]), " ".join(plain), None, ""])
    items = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [2, 3, 4]
    found = {r.doc_id: r for r in decontaminate.overlaps(docs, items).collect()}
    assert found[0].n_matched == found[0].n_words == 40 and found[1].n_matched < found[1].n_words


def test_decisions_are_made_by_row(spark):
    rng = np.random.default_rng(12)
    a, b, item = (" ".join(f"{x}{k}" for k in rng.integers(0, 9000, 60)) for x in "abq")
    near = a.replace(a.split()[30], "changed")
    rows = [(1, a), (5, near), (5, b), (7, b), (None, near), (2, a), (2, a)]
    docs = spark.createDataFrame([(d, t, "en", "web", 1) for d, t in rows], DOCS).withColumn("row", F.lit(3))
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()) == [(1, a), (5, b)]
    only_null = spark.createDataFrame([(None, near), (3, a), (None, b), (None, b)], "doc_id long, text string")
    assert sorted((r.component_id is None, r.component_id) for r in ngram_join.similar_components(only_null).collect()) == [(False, 3), (False, 3), (True, None), (True, None)]
    assert ngram_join.keep_one(only_null).count() == 2
    rows = [(1, item), (None, item), (1, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(3))
    left = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted([a, b])


def test_words_that_a_polynomial_takes_for_equal(spark):
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    found = ngram_join.similar_components(docs_of(spark, [x, y]), 3, 90, 100).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == [0, 1]
    scores = {r.doc_id: r for r in katz.katz_scores(docs_of(spark, [x, y]), F.col("doc_id") == 1).collect()}
    assert scores[1].n_known == 1


def test_large_mixed_groups_lose_no_link(spark):
    # 90 texts with one passage in common, of which the neighbours are similar
    common = " ".join(f"c{k}" for k in range(60))
    texts = [common + " " + " ".join(f"u{j // 2 * 2 if k < 8 else j}x{k}" for k in range(12)) for j in range(90)]
    found = [r.component_id for r in ngram_join.similar_components(docs_of(spark, texts)).orderBy("doc_id").collect()]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = list(range(90))
    for j in range(90):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert found == want


def test_masks_survive_two_substitutions():
    from itertools import combinations

    for wrong in combinations(range(decontaminate.MIN_WORDS), 2):
        assert any(all(m == "0" or s + k not in wrong for k, m in enumerate(mask)) for mask in decontaminate.MASKS for s in range(decontaminate.MIN_WORDS - len(mask) + 1))


def test_seeds_are_in_every_stretch_that_counts():
    # the least number of substitutions that leaves no seed, by the last eight words
    masks = [[k for k, x in enumerate(reversed(m)) if x == "1"] for m in decontaminate.MASKS]
    least = {(): 0}
    for n in range(1, 201):
        longer = {}
        for last, cost in least.items():
            for equal in (True, False):
                new = (equal, *last)[:8]  # latest word first
                if not any(len(new) > max(m) and all(new[k] for k in m) and n >= max(m) + 1 for m in masks):
                    longer[new] = min(longer.get(new, n + 1), cost + (not equal))
        least = longer
        if n >= decontaminate.LEAST_FUZZY:
            assert 5 * min(least.values()) > n, n


def test_decontamination_equals_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    for n in range(5, 31):
        words = [f"w{n}x{k}" for k in range(n)]
        items = decontaminate.Items(np.arange(1), pa.array([" ".join(words)]))
        wrong = [()] + [(k,) for k in range(n)] + [(j, k) for k in range(n) for j in range(k)]
        wrong += [tuple(rng.choice(n, m, replace=False)) for m in range(3, min(n, 9)) for _ in range(60)]
        texts = [" ".join(["before", *("other" if k in w else x for k, x in enumerate(words)), "after"]) for w in wrong]
        raw, off = decontaminate.W.bytes_of(pa.array(texts))
        h, _, _, at = decontaminate.W.word_hashes(raw, off, decontaminate.W.PLAIN)
        got = {d: rest for d, _, *rest in items.in_texts(h, at)}
        for d, w in enumerate(wrong):
            equal = np.array([k not in w for k in range(n)])
            least = min(n, 10)
            spans = [(b - a, a, b) for a in range(n) for b in range(a + least, n + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)]
            assert (d in got) == bool(spans and (n >= 8 or equal.all())), (n, w)
            if d in got:
                matched, size, at_doc, at_item = got[d]
                longest = {int(equal[a:b].sum()) for m, a, b in spans if m == max(spans)[0]}
                assert matched in longest and size >= least and 5 * matched >= 4 * size and at_doc == at_item + 1
                assert equal[at_item : at_item + size].sum() == matched


def test_warc_records_are_found_by_the_index(spark, tmp_path):
    big = "<p>" + "y" * 2000
    pages = spark.createDataFrame([(1, "http://a/\nb%", big), (2, None, big), (3, "u", None), (4, "u", "small"), (5, "u", "small")], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    rows = {r.page_id: r for r in warc.read_archives(spark, index).collect()}
    assert rows[1].record_type == "revisit" and rows[1].refers_to == 2 and rows[1].url == "http://a/\nb%"
    assert rows[3].payload_bytes == 0 and rows[4].record_type == rows[5].record_type == "response"
    for entry in index.collect():
        assert warc.read_record(entry)[0] == entry.page_id


def test_warc_with_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (7, "u", "y" * 1500), (7, "u", "y" * 1500), (None, "u", "y" * 1500), (3, "é\r\n", "")], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("digest", "archive", "p", "d", "last")})
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages, f"file://{tmp_path}/w")).collect()]
    want = [(None, 0, "response", None), (7, 1500, "response", None), (7, 1500, "response", None), (None, 1500, "revisit", 7), (3, 0, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_cover_tree_pairs_equal_brute_force():
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(np.concatenate([c + 0.05 * rng.normal(size=(20, 8)) for c in rng.normal(size=(6, 8))]))
    y = embedding_dedup.unit(rng.normal(size=(50, 8)))
    for a, b in ((x, x), (x, y)):
        i, j = embedding_dedup.close_pairs(a, embedding_dedup.cover(a), b, embedding_dedup.cover(b), 0.374)
        got = {(p, q) for p, q in zip(i.tolist(), j.tolist()) if np.linalg.norm(a[p] - b[q]) <= 0.374}
        assert got == {(p, q) for p in range(len(a)) for q in range(len(b)) if np.linalg.norm(a[p] - b[q]) <= 0.374}


def test_embeddings_with_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1e200, 1e200], 3), (13, [1e-200, 1e-200], 3), (13, [1e200, -1e200], 3)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("point", "cell", "n", "id")})).collect()}
    assert got[12] == (1, 12, True)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[None] == (3, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10))


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    scored = llm.queries()["op6_bradley_terry_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() >= 0.9
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.7) == (scored.predicted == 1)).all()


def test_quality_threshold_is_a_quantile_of_all_labelled_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 100)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, preferred = quality.learn(docs, labels, F.lit(False))
    both = preferred.join(labels.where("quality in (0, 1)"), "doc_id").toPandas()
    assert len(both) > 300
    s, bad = np.sort(both.preference), int((both.quality == 0).sum())
    assert s[bad - 1] <= model.cut <= s[bad]
    scored = quality.quality_scores(docs, labels, F.lit(False)).join(both[["doc_id"]].pipe(spark.createDataFrame), "doc_id").toPandas()
    assert (scored.predicted == 0).sum() == bad
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept & set(scored.doc_id) == set(scored.doc_id[scored.predicted == 1])


def test_quality_without_both_labels(spark):
    labels = spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert {r.predicted for r in quality.quality_scores(odd(spark), labels, F.lit(False)).collect()} == {1}


def test_packing_round_trip(spark, table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    docs = table("documents")
    rows = packing.best_fit_pack(docs).collect()
    own, bins = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(own[r.doc_id], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for p in sorted(b, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in rows) / 1024)


def test_quotes_are_linked(spark):
    m = [(1, 0, "u", "hello there my friend\nhow are you today"), (1, 1, "a", "> hello there my friend\nfine thanks a lot"), (1, 2, "u", "unrelated thing here"), (1, 3, "u", "> > hello there my friend\n> fine thanks a lot\n\ngood to hear that"), (1, 4, "a", "> how are you today\nsecond answer to you"), (1, 5, "x", None), (None, 1, "u", ">x y z\na"), (1, 6, "u", "> good to hear that\nyes"), (2, 0, "u", "> nobody said this before\nok")]
    got = [(r.position, r.turn, r.text, r.reply_to, r.depth) for r in quote_linking.conversations(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).where("conv_id = 1").orderBy("position").collect()]
    assert [g[1] for g in got] == [0, 1, 3, 6, 4, 2, 5]
    assert [g[3] for g in got] == [None, 0, 1, 3, 0, None, None] and [g[4] for g in got] == [0, 1, 2, 3, 1, 0, 0]
    assert got[2][2] == "good to hear that" and got[6][2] is None
    said = [(1, 0, "u", "what I said first here"), (1, 1, "a", "Hello,\nOn Monday, u wrote:\n> what I said first here\nmy own answer")]
    answer = quote_linking.conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("source", F.lit(1))).where("turn = 1").first()
    assert (answer.text, answer.reply_to) == ("Hello,\nmy own answer", 0)
    plain = llm.queries()["op8_quotation_linking"](spark, SF)
    assert plain.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_katz_equals_brute_force(spark):
    texts = ["a b a b c", "a b c", "b c a", "A b zz", "", None, "c c c a b", "q a b"]
    docs = docs_of(spark, texts)
    held = F.col("doc_id") % 3 == 0
    got = {r.doc_id: r for r in katz.katz_scores(docs, held, 2).collect()}
    token = lambda t: [*(t or "").lower().split(), None]
    train = [token(t) for k, t in enumerate(texts) if k % 3]
    uni = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v = sum(uni.values()), len(uni)
    context = Counter(a for a, _ in pairs.elements())
    loss = katz.discounts([sum(1 for c in pairs.values() if c == r) for r in range(1, katz.CLASSES + 1)])
    base = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(a, w):
        if a == "<s>" and not context[a] or a != "<s>" and not context[a]:
            return base(w)
        if pairs[a, w]:
            return (pairs[a, w] - loss[min(pairs[a, w], katz.CLASSES)]) / context[a]
        seen = [x for (b, x) in pairs if b == a]
        free = sum(loss[min(pairs[a, x], katz.CLASSES)] for x in seen) / context[a]
        return free * base(w) / (1 - sum(base(x) for x in seen))

    for a in ("<s>", "a", "c"):
        assert sum(p(a, w) for w in uni) + p(a, "never seen") == pytest.approx(1)
    for k, t in enumerate(texts):
        t = token(t)
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(uni[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10(base(w)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t)))


@pytest.mark.parametrize(("order", "bucket_keys"), [(3, 2_000_000), (4, 2_000_000), (3, 5)])
def test_katz_of_longer_contexts_equals_brute_force(spark, monkeypatch, order, bucket_keys):
    monkeypatch.setattr(katz, "BUCKET_KEYS", bucket_keys)  # so few that some contexts are hot
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcde"), rng.integers(0, 9), p=[0.5, 0.2, 0.1, 0.1, 0.1])) for _ in range(24)] + ["a b c d e a b", "a b c d e", None, "zz a b zz", "a a b a c"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in katz.katz_scores(docs, F.col("doc_id") % 3 == 0, order).collect()}
    token = lambda t: [*(t or "").split(), None]
    train = [token(t) for k, t in enumerate(texts) if k % 3]
    grams = {n: Counter(tuple(["<s>", *t][k : k + n]) for t in train for k in range(len(t) + 2 - n)) for n in range(2, order + 1)}
    uni = Counter(w for t in train for w in t)
    losses = {n: katz.discounts([sum(c == r for c in grams[n].values()) for r in range(1, katz.CLASSES + 1)]) for n in grams}

    def p(context, w):
        if not context:
            return (uni[w] + 0.5) / (sum(uni.values()) + 0.5 * (len(uni) + 1))
        counts, loss = grams[len(context) + 1], losses[len(context) + 1]
        seen = {g[-1]: c for g, c in counts.items() if g[:-1] == context}
        whole, lost = sum(seen.values()), lambda c: loss[min(c, katz.CLASSES)]
        if not seen:
            return p(context[1:], w)
        if w in seen:
            return (seen[w] - lost(seen[w])) / whole
        return sum(map(lost, seen.values())) / whole * p(context[1:], w) / (1 - sum(p(context[1:], x) for x in seen))

    for context in (("<s>", "a"), ("a", "b"), ("a", "a"), ("b", "zz")):
        assert sum(p(context, w) for w in uni) + p(context, "never seen") == pytest.approx(1)
    for k, t in enumerate(texts):
        t = token(t)
        all_words = ["<s>", *t]
        assert got[k].score == pytest.approx(sum(math.log10(p(tuple(all_words[max(0, j + 2 - order) : j + 1]), w)) for j, w in enumerate(t)))


def test_suffix_dedup_equals_brute_force(spark, table):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefg "), 300))
    extra = [passage, "x" + passage[50:260], "ab" * 400, passage[:99], "é☃" * 80, passage[100:] + passage[:150]]
    licence = "".join(rng.choice(list("hijklm "), 240))
    extra += [f"{k}{licence}{k}" for k in range(30)]  # one passage in very many documents, in several blocks
    docs = table("documents").limit(60).unionByName(docs_of(spark, extra, 10_000)).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs).collect()}
    seen = set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        keep = np.ones(len(b), bool)
        for at in range(len(b) - 99):
            s = b[at : at + 100]
            if s in seen:
                keep[at : at + 100] = False
            seen.add(s)
        spans = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        assert got[r.doc_id] == (len(b), int((~keep).sum()), spans, hashlib.sha256(left).hexdigest())


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(6)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()) for _ in range(n)) for n in (5, 1, 9, 0, 4)]
    shared = [suffix_dedup.front_code(r)[0].tolist() for r in runs]
    for r in runs:
        assert suffix_dedup.front_decode(*suffix_dedup.front_code(r)) == r
    order, lcp = suffix_dedup.merge_runs(runs, shared)
    at, out = [0] * 5, []
    for k in order:
        out.append(runs[k][at[k]])
        at[k] += 1
    assert out == sorted(x for r in runs for x in r)
    assert lcp[1:] == [suffix_dedup.common(a, b) for a, b in zip(out, out[1:])]


DOCUMENT_OPERATORS = {
    "lines": lambda spark, df: line_dedup.line_components(df),
    "dedup_lines": lambda spark, df: line_dedup.dedup_lines(df),
    "ngram": lambda spark, df: ngram_join.similar_components(df),
    "keep_one": lambda spark, df: ngram_join.keep_one(df),
    "decontaminate": lambda spark, df: decontaminate.decontaminate(df, spark.read.parquet(f"{SF}/benchmark.parquet")),
    "quality": lambda spark, df: quality.quality_scores(df, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(False)),
    "keep_good": lambda spark, df: quality.keep_good(df, spark.read.parquet(f"{SF}/labels.parquet")),
    "pack": lambda spark, df: packing.best_fit_pack(df),
    "katz": lambda spark, df: katz.katz_scores(df, F.lit(False)),
    "suffix": lambda spark, df: suffix_dedup.digests(df),
    "suffix_text": lambda spark, df: suffix_dedup.remove_repeats(df),
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_odd_and_empty_documents(spark, name):
    run = DOCUMENT_OPERATORS[name]
    assert run(spark, empty(spark)).count() == 0
    n = run(spark, odd(spark)).count()
    if name in ("ngram", "quality", "katz", "suffix", "suffix_text"):
        assert n == 9
    if name == "pack":
        assert n > 9
    if name in ("keep_good", "dedup_lines", "keep_one", "decontaminate"):
        assert run(spark, odd(spark)).columns == odd(spark).columns


def test_other_empty_tables(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert quote_linking.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark, table):
    docs = table("documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
