"""Token files, source divergence and spelling variants against brute force, round trips and odd inputs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import llm
from weftline.llm import prefix_tries, spelling, token_store
from weftline.llm.packing import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(1, None, None, None, None), (None, "a b c d e f g", None, None, 13), (None, "same text here", "en", None, 1), (2, "", "en", "x", 0), (3, "wording " * 30_000, "en", "x", 1), (4, "x" * 120_000, "en", "x", 1), (5, "same text here", "en", "x", 1), (5, "same text here", "en", "x", 1), (6, " \n\t\n", "", "x", 1), (7, "é☃𝄞 ñandú ÷×ÿ <|endoftext|>", "es", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("part", "file", "segment", "start", "n_ids", "word", "n", "key", "form", "root", "range", "groups", "body", "item", "value", "rank", "total", "v")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def oracle(name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(llm.oracle_sql()[name])
    return rel.columns, sorted(rel.fetchall(), key=str)


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_spelling_variants"])
def test_oracles(spark, name):
    columns, want = oracle(name)
    got = llm.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want


# token files


def plain_ids(text):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [*found.encode(text or "", add_special_tokens=False).ids, 0]


def as_read(docs):
    """What the query must return for rows ``doc_id, text`` in their order."""
    out, start = [], 0
    for doc, text in docs:
        ids = plain_ids(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_is_the_tokenizer_in_order_of_ids(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in llm.queries()["op11_token_store"](spark, SF).collect())
    assert got == as_read(docs)


def test_tokens_of_odd_rows_and_of_none(spark, tmp_path):
    manifest = token_store.write_tokens(odd(spark), f"file://{tmp_path}/odd")
    got = sorted((tuple(r) for r in token_store.read_documents(manifest).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text) for r in odd(spark).select("doc_id", "text").collect()]
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))  # rows without an id come first
    assert sorted((r[0] is None, r[0] or 0, *r[2:]) for r in got) == sorted((r[0] is None, r[0] or 0, *r[2:]) for r in as_read(rows))
    starts = np.cumsum([0] + [r[2] for r in got])
    assert [r[1] for r in got] == starts[:-1].tolist()
    nothing = token_store.write_tokens(empty(spark), f"file://{tmp_path}/none")
    assert nothing.count() == 0 and token_store.read_documents(nothing).count() == 0


def test_any_token_is_found_alone_across_files_and_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 700)  # of the driver: cells of the look-up are as small as that
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = token_store.write_tokens(docs, f"file://{tmp_path}/some")
    ids = [i for r in sorted(tuple(r) for r in docs.select("doc_id", "text").collect()) for i in plain_ids(r[1])]
    wanted = [*range(0, len(ids), 997), len(ids) - 1, len(ids), -1, None, 5, 5]
    found = token_store.tokens_at(manifest, spark.createDataFrame([(p,) for p in wanted], "position long")).collect()
    assert sorted(map(tuple, found)) == sorted((p, ids[p]) for p in wanted if p is not None and 0 <= p < len(ids))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=40), min_size=1, max_size=40))
def test_segments_give_back_all_ids_and_each(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    body = token_store.segment_bytes([None, *range(1, len(docs))], np.array([len(d) for d in docs]), ids)
    found = token_store.Segment(lambda at, n: body[at : at + n])
    assert found.ids().tolist() == ids.tolist() == [found.token(k) for k in range(len(ids))]
    names, first = found.documents()
    assert names == [None, *range(1, len(docs))] and np.diff(first).tolist() == [len(d) for d in docs]


def test_a_token_costs_few_bytes_and_ids_few_bits():
    ids = np.random.default_rng(3).zipf(1.3, 200_000).clip(max=50_256).astype(np.uint32)
    body, read = token_store.segment_bytes([1], np.array([len(ids)]), ids), []
    found = token_store.Segment(lambda at, n: read.append(n) or body[at : at + n])
    read.clear()
    assert found.token(123_456) == ids[123_456] and sum(read) < 90 * len(found.levels)
    assert len(body) < 1.5 * len(ids)
    widths = token_store.level_widths(ids)
    cost = lambda ws: sum(int((ids >> np.uint32(sum(ws[:k])) > 0).sum() if k else len(ids)) * (w + (k + 1 < len(ws))) for k, w in enumerate(ws))
    assert sum(widths) == 16 and cost(widths) <= min(cost([16]), cost([8, 8]), cost([4, 4, 4, 4]), cost([5, 5, 6]))


# source divergence


def brute_divergence(rows, least_docs, places=50):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall((text or "").translate(LOWER))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least_docs}
        own = {s: {t: count[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(own[s][t] for s in own) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(own[s]) for s in own}
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            best = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:places]
            out += [(lang, s, part, x, -f, k) for part, found in (("pair", pairs), ("term", best)) for k, (f, _, x) in enumerate(found, 1)]
    return sorted(out)


def divergence(df, **how):
    return sorted(map(tuple, prefix_tries.source_divergence(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_of_odd_rows_and_of_none(spark):
    rows = [(r.text, r.lang, r.source) for r in odd(spark).select("text", "lang", "source").collect()]
    for least in (1, 2, 30):
        assert divergence(odd(spark), least_docs=least) == brute_divergence(rows, least)
    assert divergence(empty(spark)) == []


def test_divergence_with_small_ranges_many_blocks_and_a_hot_source(spark, monkeypatch):
    """Cuts, both merging steps and blocks of a matrix are used; a third of all rows have one source, ties are many."""
    rng = np.random.default_rng(5)
    words = [a + b + c for a in ("a", "é", "th", "日本", "z") for b in ("", "o", "øx", "日") for c in ("n", "m", "nn", "😀")]
    rows = [(" ".join(rng.choice(words, 20)) + " The THE ÉA", str(rng.choice(["en", "de"])), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(300)]
    df = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], DOCS).repartition(6)
    assert divergence(df, least_docs=5) == brute_divergence(rows, 5)
    cut = [prefix_tries.Trie.of([b"b", b"a", b"ab", b"a"], np.array([0, 1, 2, 3]), np.array([0, 0, 1, 0]), np.array([1, 2, 3, 4]), np.ones(4, np.int64), [("en", "x"), ("en", "y")])]
    blocks = prefix_tries.blocks_of(cut[0])
    assert blocks.num_rows == 1 and cut[0].terms == [b"a", b"ab", b"b"] and cut[0].count.tolist() == [6, 3, 1]
    stored = prefix_tries.stored(prefix_tries.term_blocks(df.select("lang", "source", "text").repartition(40)), "test-blocks")
    monkeypatch.setattr(prefix_tries, "RANGE_COUNTERS", 200)
    monkeypatch.setattr(prefix_tries, "FAN_IN", 1)
    found = prefix_tries.kept_terms(stored, 5).collect()
    assert len(found) > 2  # several ranges of each lang
    whole = {lang: sum(r.n_terms for r in found if r.lang == lang) for lang in ("en", "de")}
    sums = Counter()
    for r in found:
        sums.update({(r.lang, s): n for s, n in zip(r.sources, r.sums)})
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = {lang: Counter(t for text, x, _ in rows if x == lang for t in set(term.findall(text.translate(LOWER)))) for lang in whole}
    kept = {lang: {t for t, n in docs[lang].items() if n >= 5} for lang in whole}
    assert whole == {lang: len(kept[lang]) for lang in kept}
    want = Counter()
    for text, lang, source in rows:
        want[lang, source] += sum(t in kept[lang] for t in term.findall(text.translate(LOWER)))
    assert sums == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text(min_size=1, max_size=6), st.integers(0, 3)), min_size=1, max_size=30), min_size=1, max_size=4), st.text(min_size=1, max_size=3))
def test_merged_and_cut_tries_keep_all_counters(tasks, at):
    names = [("en", f"s{k}") for k in range(4)]
    tries = []
    for rows in tasks:
        one = prefix_tries.Trie.of([t.encode("utf-8", "replace") for t, _ in rows], np.arange(len(rows)), np.array([g for _, g in rows]), np.ones(len(rows), np.int64), np.ones(len(rows), np.int64), names)
        tries.append(prefix_tries.Trie.read(*one.body()))
    whole = prefix_tries.Trie.merged(tries)
    flat = lambda t: {(term, t.names[g]): n for k, term in enumerate(t.terms) for g, n in zip(t.group[t.at[k] : t.at[k + 1]].tolist(), t.count[t.at[k] : t.at[k + 1]].tolist())}
    assert flat(whole) == Counter((t.encode("utf-8", "replace"), names[g]) for rows in tasks for t, g in rows)
    assert whole.terms == sorted(whole.terms)
    k = sum(t < at.encode("utf-8", "replace") for t in whole.terms)
    assert flat(whole.cut(0, k)) | flat(whole.cut(k, len(whole.terms))) == flat(whole)


def test_shares_are_exact_far_beyond_doubles():
    rng = np.random.default_rng(1)
    for n_terms in (1, 77, 10**6):
        total = int(rng.integers(10**10, 10**13))
        count = rng.integers(0, total, 200)
        assert prefix_tries.shares(count, np.int64(total), n_terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * n_terms) for c in count]


# spelling variants


def brute_spelling(rows, least_count, every=199, times=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in n:
        own = [o for o in n if near(w, o)]
        best = min(own, key=lambda o: (-n[o], o), default=None)
        out[w] = (best if best and n[best] >= times * n[w] else None, len(own))
    rows = []
    for w, (form, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(rows, key=str)


def spelled(df, **how):
    return sorted(map(tuple, spelling.spelling_variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_spelling_of_generated_words(spark, hot):
    """Replaced, lost and added letters at every place; with ``hot`` 1, all shards are dealt out by gram and place."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abé"), rng.integers(5, 10))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "ßßßßßß", "wordingly"]
    texts = [(k, " ".join(str(w) for w in rng.choice(words, 40, p=np.arange(1, len(words) + 1) / sum(range(1, len(words) + 1))))) for k in range(40)]
    got = spelled(spark.createDataFrame(texts, "doc_id long, text string"), least_count=1, every=7, hot=hot)
    assert got == brute_spelling(texts, 1, 7) and any(r[1] for r in got) and any(r[4] > 2 for r in got)


def test_spelling_of_odd_rows_and_of_none(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).select("doc_id", "text").collect()]
    for least in (1, 5):
        assert spelled(odd(spark), least_count=least) == brute_spelling(rows, least)
    assert spelled(empty(spark)) == []


def test_chains_of_forms_end_in_their_root(spark):
    text = " ".join(["aaaaaab"] * 1 + ["aaaaaac"] * 5 + ["aaaaadc"] * 25 + ["aaaaedc"] * 125)
    got = {r[0]: r for r in spelled(spark.createDataFrame([(1, text)], "doc_id long, text string"), least_count=1, every=1 << 40)}
    assert {w: r[2] for w, r in got.items()} == dict.fromkeys(got, "aaaaedc") and got["aaaaaab"][1] == "aaaaaac"


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_one_edit(a, b):
    def within(x, y):
        return any(x[:k] + x[k + 1 :] == y for k in range(len(x)))

    same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    assert spelling.one_edit(a, b) == (same or within(a, b) or within(b, a))


def test_encoder_that_forgets_and_grows_is_the_tokenizer(monkeypatch):
    """A table that is too small at first, and memories that are dropped: the ids stay those of the tokenizer."""
    from weftline.llm import packing
    from weftline.llm import words as W

    monkeypatch.setattr(packing, "PLACES", 64)
    monkeypatch.setattr(packing, "REMEMBERED", 3000)
    own = packing.WordwiseEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(11)
    letters = list("abcdefé ßü  .,;\n\n\t'’0179<|>日本😀") + ["<|endoftext|>", "'s", " the", " ", "　"]
    for n in (1, 50, 4000, 20, 4000):
        texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(n)]
        import pyarrow as pa

        raw, off = W.bytes_of(pa.array(texts))
        ids, at = own.encode(raw, off)
        want = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


# quotation linking


def test_generated_reply_trees_are_found_and_quotes_taken_out(spark):
    """Answers quote all or one of the lines of what they answer, some with its own quotes nested, under announcements in any language, marked in several ways."""
    from weftline.llm import quote_linking

    rng = np.random.default_rng(8)
    rows, want = [], {}
    for conv in range(12):
        own, text = {}, {}
        for turn in range(int(rng.integers(2, 14))):
            own[turn] = [f"conversation {conv} says {turn} with {k} {rng.integers(1 << 30)}" for k in range(int(rng.integers(1, 4)))]
            up = int(rng.integers(0, turn)) if turn and rng.random() < 0.8 else None
            lines = []
            if up is not None:
                mark = str(rng.choice(["> ", ">", " > "]))
                some = own[up] if rng.random() < 0.5 else [own[up][int(rng.integers(len(own[up])))]]
                nested = [x for x in text[up] if x.lstrip().startswith(">")] if rng.random() < 0.5 else []
                lines = [str(rng.choice(["Am Montag schrieb u:", "On Monday, u wrote:", "u a écrit :"]))] * int(rng.integers(0, 2)) + [mark + x.upper() for x in nested + some]
            text[turn] = lines + own[turn]
            rows.append((conv, turn, "u", "\n".join(text[turn])))
            want[conv, turn] = (up, "\n".join(own[turn]))
    got = quote_linking.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.text) for r in got} == want
    order = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.position)):
        order.setdefault(r.conv_id, []).append(r.turn)
    for conv, turns in order.items():
        below = lambda up: [x for t in sorted(t for (c, t), w in want.items() if c == conv and w[0] == up) for x in (t, *below(t))]  # noqa: E731, B023
        assert turns == below(None)


def test_lines_that_only_look_like_quotes_stay(spark):
    from weftline.llm import quote_linking

    rows = [(1, 0, "u", ">>> 1 + 1\n2\nthat is how"), (1, 1, "a", "see:\n> nobody said this here\nok"), (2, 0, "u", ">"), (2, 1, "u", "")]
    got = quote_linking.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got) == sorted(rows) and all(r.reply_to is None for r in got)


# decontamination


def brute_overlaps(docs, items, least_item=5, least_fuzzy=8, min_words=10):
    """By all diagonals of all pairs: the best stretch of each document and item."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER))
    out = {}
    for d, text in docs:
        mine = words(text)
        for i, item in items:
            own = words(item)
            least = min(min_words, len(own))
            for shift in range(-len(own) + 1, len(mine)) if own else ():
                lo, hi = max(0, -shift), min(len(own), len(mine) - shift)
                equal = np.array([own[k] == mine[k + shift] for k in range(lo, hi)], bool)
                if hi - lo < least:
                    continue
                total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
                spans = [(b - a, -a, a, b) for a in range(len(total)) for b in range(a + least, len(total)) if total[b] >= total[a]]
                if not spans:
                    continue
                _, _, a, b = max(spans)
                while b - a > least and not equal[b - 1]:
                    b -= 1
                while b - a > least and not equal[a]:
                    a += 1
                matched = int(equal[a:b].sum())
                if least >= least_fuzzy or matched == least >= least_item:
                    out[d, i] = max(out.get((d, i), (0, 0, 0, 0)), (matched, a - b, -(lo + a + shift), -(lo + a)))
    return {(d, i, m, -n, -x, -y) for (d, i), (m, n, x, y) in out.items()}


@pytest.mark.parametrize("bounds", [{}, {"least_item": 1}, {"least_item": 3, "least_fuzzy": 9, "min_words": 12}])
def test_overlaps_with_several_items_masks_and_blocks_equal_brute_force(spark, monkeypatch, bounds):
    """Items of 1 to 25 words, planted with substitutions in texts of few different words, so that seeds repeat; in one pass and in several, in small pieces."""
    from weftline.llm import decontaminate

    rng = np.random.default_rng(3)
    some = [f"w{k}" for k in range(14)]
    items = [(k, " ".join(rng.choice(some, n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 25, 25])] + [(50, "w1 " * 14), (51, ""), (52, None), (53, "w1 w2 " * 8)]
    docs = []
    for k in range(24):
        words = list(rng.choice(some, int(rng.integers(0, 60))))
        item = (items[int(rng.integers(len(items)))][1] or "").split()
        item = [w if rng.random() > 0.12 else "zzz" for w in item]
        docs.append((k, " ".join(words[:20] + item + words[20:])))
    docs += [(90, "w1 " * 70), (91, "w2 w1 " * 30), (92, None), (93, "")]
    want = brute_overlaps(docs, items, **bounds)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.overlaps(d, i, **bounds).collect()} == want and len(want) > 10
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert {tuple(r) for r in decontaminate.overlaps(d, i, **bounds).collect()} == want
    with pytest.raises(ValueError):
        decontaminate.overlaps(d, i, least_fuzzy=5)


def test_very_repetitive_texts_cost_little():
    """A thousand times one word against two hundred thousand times: a second or so, not all pairs of places."""
    import time
    import tracemalloc

    import pyarrow as pa

    from weftline.llm import decontaminate
    from weftline.llm import words as W

    items = decontaminate.Items(np.arange(1), pa.array(["word " * 1000]))
    h, _, _, at = W.word_hashes(*W.bytes_of(pa.array(["word " * 200_000])), W.PLAIN)
    tracemalloc.start()
    began = time.time()
    assert list(items.in_texts(h, at)) == [(0, 0, 1000, 1000, 0, 0)]
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


# embedding near-dedup


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.5, 1.2, None]), ("long", [1 << 40, 5, 1 << 40, None]), ("string", ["a", "b", "a", None]), ("int", [1, 2, 1, None])])
def test_labels_of_any_type_are_compared_as_they_are(spark, kind, labels):
    from weftline.llm import embedding_dedup

    rows = spark.createDataFrame([(k, [1.0, 0.5], x) for k, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(rows).collect()}
    assert got == {0: (1, 0, True), 1: (0, 1, True), 2: (1, 0, False), 3: (0, 3, True)}


# pipeline


def test_a_pipeline_leaves_few_tables(spark):
    """Of all tables that its stages store, those that the result is read from are left, and small ones with decisions."""
    import os

    import corpus_pipeline
    from weftline.llm.scratch import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100
    left = set(os.listdir(root)) - before
    size = sum(os.path.getsize(os.path.join(at, f)) for x in left for at, _, files in os.walk(f"{root}/{x}") for f in files)
    kinds = sorted(x.removeprefix("weftline-").rsplit("-", 1)[0] for x in left)
    assert kinds == sorted({"again", "gone", "gone-lines", "pieces", "stage-benchmark_decontamination"} | (set(kinds) & {"preferences"}))
    assert size < 1.5 * os.path.getsize(f"{SF}/documents.parquet")
