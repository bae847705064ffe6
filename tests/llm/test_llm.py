import struct
import time
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from brute import held_items, near, repeats, rules as brute_rules, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulsecohort.llm import bpe, chat, common, components, decontam, neardup, quality, queries, rules, sitetree, sql, store, suffix, toxicity

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(120))
ODD = [
    (1, None), (2, ""), (None, LONG), (None, LONG), (3, "short"), (3, "other words with the same id"), (4, "a" * 300), (5, "b" + "a" * 120 + "c" + "a" * 80), (6, LONG.upper()), (7, LONG.replace("word50 ", "x ")),
    (8, "é" * 60 + LONG[3:90]), (9, " \n\t"), (9, " \n\t"), (10, "\x00 \x1c # < \\ ok"), (11, "x" * 100_000),
]


def docs(spark, rows, extra=True):
    out = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC)
    # names that the operators use themselves
    return out.withColumn("rid", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("words", F.lit(None).cast("string")) if extra else out


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents benchmark labels conversations pages".split():
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def same(df, duck, text):
    cols = sorted(df.columns)
    found = duck.execute(text)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, duck, name):
    same(queries.queries()[name](spark, FOLDER), duck, sql.oracle_sql()[name])


@pytest.mark.parametrize("rows", [ODD, []])
def test_near_duplicates_by_brute_force(spark, rows):
    got = neardup.near_duplicates(docs(spark, rows), 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(near(rows, 3, 85))


def test_large_group_without_pairs(spark):
    g = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in g.choice(100, int(g.integers(0, 6)), replace=False):
            w[j] = f"v{i}_{j}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(docs(spark, rows), 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(near(rows, 3, 85))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (7, None), (3, 9), (4, 5)]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 1)]
    path = [(i, i + 1) for i in range(40)]
    assert {r[1] for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()} == {0}


@pytest.mark.parametrize("rows", [ODD, []])
def test_repeats_by_brute_force(spark, rows):
    got = suffix.remove_repeats(docs(spark, rows)).collect()
    want = [(d, len((t or "").encode()), gone, spans, sha(kept)) for (d, t), (kept, gone, spans) in zip(rows, repeats(rows))]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(want)


def test_runs_do_not_depend_on_segments():
    g = np.random.default_rng(6)
    flat = g.integers(97, 100, 3000).astype(np.uint8)
    a = suffix.runs_of(flat, np.array([0, 1000, 1010, 3000]))
    b = suffix.runs_of(flat, np.array([0, 1000, 1010, 3000]), segment=500)
    cover = lambda r: {(d, lo + i) for d, lo, n in zip(*r[:3]) for i in range(n)}
    assert cover(a) == cover(b)


def test_rules_on_odd_rows(spark):
    got = rules.quality_rules(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert rules.quality_rules(docs(spark, [])).count() == 0


def test_frequent_lines_go_and_the_first_stays(spark):
    body = lambda i: " ".join(f"t{i}_{j}" for j in range(60))
    rows = [(i, f"The  same LINE here\n{body(i)}") for i in range(40)]
    out = rules.apply_quality_rules(docs(spark, rows, False)).orderBy("doc_id").collect()
    assert out[0]["text"].startswith("The") and all(r["text"] == body(r["doc_id"]) for r in out[1:]) and len(out) == 40


def test_byte_bpe_matches_the_library(spark):
    ranks = bpe.load_ranks(bpe.read_vocabulary(queries.BYTE_VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*ODD, (20, "don't it's 1234 …  ﬁ 中文 😀  \n\n x"), (21, " " * 500), (22, "ab" * 2000)]
    encoded = bpe.encode_documents(docs(spark, rows), queries.BYTE_VOCABULARY, P.PATTERN)
    back = bpe.decode_documents(encoded, queries.BYTE_VOCABULARY, P.PATTERN).collect()
    want = Counter((d, tuple(library.encode_ordinary(t or "")), t or "") for d, t in rows)
    assert Counter((r["doc_id"], struct.unpack(f"<{r['n_tokens']}I", r["ids"]), r["decoded"]) for r in back) == want
    assert bpe.encode_documents(docs(spark, []), queries.BYTE_VOCABULARY, P.PATTERN).count() == 0


def test_full_tables_change_nothing():
    ranks = bpe.load_ranks(bpe.read_vocabulary(queries.BYTE_VOCABULARY))
    a, b = bpe.Transducer(ranks), bpe.Transducer(ranks, limit=3)
    for w in (LONG, "thndntes", "x" * 300, "überraschung", "\n\n\n  \t"):
        assert a.encode_piece(w.encode()) == b.encode_piece(w.encode())
        parts = a.merged(w.encode())
        assert [ranks[p] for p in parts] == a.encode_piece(w.encode()) or w.encode() in ranks


def test_stream_decoder_splits_characters():
    ranks = {bytes([i]): i for i in range(256)}
    d = bpe.StreamDecoder(ranks)
    assert list(d.stream("é€".encode())) == ["", "é", "", "", "€"]
    assert d(b"a\xe2\x82") == "a�"


def test_store_round_trip(spark):
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    rows = [*ODD, (20, "Don't stop. A,b c, <|endoftext|> É, ́x …, 'S"), (21, LONG + LONG)]
    folder = store.write_store(docs(spark, rows), queries.WORD_VOCABULARY, store.new_folder(spark))
    want, start = Counter(), 0
    texts = sorted(((d is None, d or 0, t or "") for d, t in rows), key=lambda x: x[:2])
    lengths = Counter()
    for null, d, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        lengths[None if null else d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    got = store.verify_store(spark, folder).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == lengths
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(d for d, _ in rows if d is not None)
    names = [r["name"] for r in store.read_chunks(spark, folder).collect()]
    assert len(names) == len(set(names))
    assert sum(len(r["ids"]) for r in store.read_documents(spark, folder).collect()) == start
    assert store.verify_store(spark, store.write_store(docs(spark, []), queries.WORD_VOCABULARY, store.new_folder(spark))).count() == 0


def test_store_equals_the_library_on_all_documents(spark):
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r["ids"] for r in store.read_documents(spark, store.write_store(table, queries.WORD_VOCABULARY, store.new_folder(spark), parts=3)).collect()}
    assert found == {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in table.collect()}


def test_words_are_taken_apart_as_the_library_does():
    library, encode = Tokenizer.from_file(queries.WORD_VOCABULARY), store.WordEncoder(bpe.read_vocabulary(queries.WORD_VOCABULARY))
    g = np.random.default_rng(21)
    alphabet = [*"abzßéÉÅÿ'.,;<>|# \t\n\x0b\x1c\u00a0\u0301\u0338Σς1٣_`^中😀", "<|endoftext|>", "<|StartOfText|>", "'s", "don't", "…"]
    for _ in range(3000):
        text = "".join(alphabet[i] for i in g.integers(0, len(alphabet), int(g.integers(0, 25))))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_and_trees_by_definition():
    g = np.random.default_rng(22)
    ids = g.integers(0, 50_000, 5000).astype("<u4")
    x = (ids.astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    plain = [sum(int(x[i - j]) * pow(0xBF58476D1CE4E5B9, j, 1 << 64) for j in range(min(16, i + 1))) % (1 << 64) for i in range(len(x))]
    assert store.rolling(ids).tolist() == [h ^ h >> 32 for h in plain]
    assert store.cuts(np.array([10, 100, 9000]), 9001) == [100, 8292, 9000, 9001] and store.cuts(np.array([], int), 0) == []

    def by_level(level):
        while len(level) > 1:
            level = [sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    for n in range(1, 40):
        leaves = [bytes([i]) for i in range(n)]
        assert store.merkle_root(leaves) == by_level([sha256(b"\x00" + v).digest() for v in leaves])


def test_store_notices_damage(spark):
    folder = store.write_store(docs(spark, [(1, LONG)]), queries.WORD_VOCABULARY, store.new_folder(spark))
    bad = store.read_chunks(spark, folder).withColumn("data", F.expr("concat(data, x'0000')"))
    bad = spark.createDataFrame(bad.collect(), bad.schema)
    bad.write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="doesn't match"):
        store.verify_store(spark, folder).collect()


def test_crc_joins():
    a, b = b"hello" * 50, b"\x00\x01world" * 31
    assert store.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_chat_odd_turns(spark):
    rows = [(1, 1, "assistant", "a\\n<#"), (1, 0, None, None), (1, 2, "assistant", "b"), (None, 0, "u\n#", "x"), (None, 0, "u\n#", "x"), (2, 0, "assistant", "")]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("", ""), ("assistant", "a\\n<#"), ("assistant", "b")]
    assert back[1]["loss_text"] == "a\\n<#b" and back[1]["formatted"].count("### assistant") == 1
    assert [tuple(t) for t in back[None]["turns"]] == [("u\n#", "x")] * 2 and back[2]["loss_text"] == ""


def page(body):
    return f"<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><ul><li>menu</ul></nav>{body}<footer>&copy; f</footer></body></html>"


def test_main_text(spark):
    pages = [
        (1, "http://a.example/1", page("<div class='ad'>buy</div><article><h1>T &amp; u</h1><p><b>one<br><p>two &#233;&nbsp; x</p><div class=comments>bad</div></article>")),
        (2, None, None), (3, "x", ""), (4, "http://a.example/2", page("<form><p>q</p></form><p>plain <i>text</i></p><aside>s</aside><!-- c --><div id=cookie-notice>n</div>")), (5, "u", "<p>a < b"),
    ]
    got = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & u one two é x", 2: "", 3: "", 4: "plain text", 5: "a < b"}
    assert sitetree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_drops_what_a_site_repeats(spark):
    pages = [(i, f"http://s.example/{i}", f"<body><div class=top>Welcome to the site</div><div class=body><p>text number {i} is {i * i}</p></div></body>") for i in range(30)]
    pages += [(100 + i, f"http://t.example/{i}", "<body><div class=body><p>one page copied</p></div></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text number {i} is {i * i}" for i in range(30)) and all(got[100 + i] == "one page copied" for i in range(30))


def test_content_root_holds_the_page():
    def text(body):
        found = sitetree.page_blocks(f"<body>{body}</body>")
        root = sitetree.page_root(found)
        return " ".join(t for t, _, drop, r in found if not drop and root in (0, r))

    body = "<p>The body of the post, long enough</p>"
    plain = "The body of the post, long enough"
    assert text(f"<div class='post'>{body}</div><section id='comments'><article><p>hi</p></article></section>") == plain
    assert text(f"<div class='post'>{body}</div><aside><article><p>teaser</p></article></aside>") == plain
    assert text(f"<div class='post'>{body}</div><div class=x><article>one</article><article>two</article></div>") == plain + " one two"
    assert text(f"<div class='post'>{body}</div><article class=comment>hi</article>") == plain
    assert text(f"<article>{body}<article class=comment>hi</article></article><div>elsewhere</div>") == plain
    assert text(f"<main class=has-sidebar><article class=tag-social>{body}</article></main>") == plain
    assert text(f"<article class=notice>{body}</article>") == plain


def test_style_tree_judges_inside_article(spark):
    boxes = "".join(f"<div class=b{c}>Read us every day</div>" for c in "abcdefghijkl")
    pages = [(i, f"http://s.example/{i}", f"<body><article><h1>Title {i}</h1><p>text number {i} is {i * i}</p>{boxes}</article></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} text number {i} is {i * i}" for i in range(30)}


@pytest.mark.parametrize("n", [3, 6, 12, 19])
def test_style_tree_of_few_pages(spark, n):
    pages = [(i, f"http://s.example/{i}", f"<body><div class=top>Welcome to the site</div><div class=body><p>text number {i} is {i * i}</p></div></body>") for i in range(n)]
    got = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: ("" if n > 4 else "Welcome to the site ") + f"text number {i} is {i * i}" for i in range(n)}


def test_contents_of_one_page_all_count(spark):
    # 9,000 contents on all 20 pages, 20,000 on one each: importance 0.69, but 0.1 if 1,000 of the latter counted
    page = lambda i: "".join(f"<p>s{j}</p>" for j in range(9000)) + "".join(f"<p>u{i}_{j}</p>" for j in range(1000))
    pages = [(i, f"http://s.example/{i}", f"<body>{page(i)}</body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(len(t.split()) == 10000 for t in got.values())


def all_maximal(values, a, b):
    """The best run of values[a:b], and those of what lies on both sides of it."""
    best = max(((values[i:j].sum(), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, a, a))
    if best[0] <= 0:
        return []
    return [*all_maximal(values, a, best[2]), (best[2], best[3] - 1), *all_maximal(values, best[3], b)]


def test_maximal_segments():
    g = np.random.default_rng(8)
    for _ in range(120):
        x = np.where(g.random(30) < 0.5, g.normal(0.6, 1.5, 30), 0)
        s = x - 0.7
        found = toxicity.maximal_segments([(i, float(v)) for i, v in enumerate(x) if v], 0.7)
        assert [(a, b) for a, b, _ in found] == all_maximal(s, 0, 30)
        assert all(abs(s[a : b + 1].sum() - v) < 1e-9 for a, b, v in found)
    began = time.process_time()
    # hits far apart, each a segment of its own that begins lower than all before it; and rising ones
    assert len(toxicity.maximal_segments([(10 * i, 1.0) for i in range(200_000)], 0.7)) == 200_000
    assert len(toxicity.maximal_segments([(2 * i, 1.5 - 1e-6 * i) for i in range(50_000)], 0.7)) > 0
    assert time.process_time() - began < 20


def test_evidence_against_the_label_counts(spark):
    rows = [(3 * i, "fine calm words here" if i % 2 else "awful nasty words here") for i in range(200)]
    labels = spark.createDataFrame([(d, int("nasty" in t), 0) for d, t in rows], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs(spark, rows), labels)
    assert model.scores["calm"] < 0 < model.scores["nasty"] and model.k != toxicity.Model().k
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs(spark, [(1, "nasty"), (2, "nasty calm calm"), (3, "")]), model).collect()}
    assert score[1] > score[3]
    assert toxicity.score_documents(docs(spark, []), model).count() == 0


def test_quality_features_do_not_change_with_length():
    text = "½²Ⅷ words "
    assert abs(quality.features(text * 409)[9] - quality.features(text * 411)[9]) < 0.01
    # a letter is a word character but digits and the underscore
    assert quality.features("a1½" * 10)[9] == 4 / 3


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in out if r["toxic"] == 1], [r["score"] for r in out if r["toxic"] == 0]
    assert np.mean([[a > b or 0.5 * (a == b) for b in neg] for a in pos]) > 0.85
    hit = [r["toxic"] for r in out if r["predicted"] == 1]
    assert np.mean(hit) > 0.95
    model = toxicity.Model(scores={"bad": 5.0})
    odd = toxicity.score_documents(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.learn(docs(spark, ODD), labels).scores == {}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(~queries.train_fold(F.col("doc_id"))).collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in out]) > 0.95
    odd = quality.quality_scores(docs(spark, ODD), spark.createDataFrame([], "doc_id long, quality int"))
    assert odd.count() == len(ODD) and odd.where("kept").count() == len(ODD)
    assert quality.quality_scores(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_leaks_and_recall(spark):
    d, b = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {r["doc_id"] for r in decontam.leaks(d, b).collect()}
    assert got == held_items([tuple(r) for r in d.select("doc_id", "text").collect()], [r["text"] for r in b.collect()])
    # paraphrases: every eighth word changed, set into another text
    items = [(r["item_id"], r["text"]) for r in b.orderBy("item_id").collect() if len(r["text"].split()) >= 20]
    changed = [(1000 + i, LONG + " " + " ".join("changed" if j % 8 == 5 else w for j, w in enumerate(t.split())) + " " + LONG) for i, t in items]
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(spark, changed).select("doc_id", "text").unionByName(d.select("doc_id", "text")), b).collect()}
    assert np.mean([(d, d - 1000) in found for d, _ in changed]) >= 0.9
    odd = decontam.decontaminate(docs(spark, ODD), b)
    assert odd.where("kept").count() == len(ODD)
    assert decontam.decontaminate(docs(spark, ODD), b.limit(0)).where("kept").count() == len(ODD)
    assert decontam.decontaminate(docs(spark, []), b).count() == 0


def test_recall_against_the_verdict_on_every_place(spark):
    d, b = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    g = np.random.default_rng(12)
    hosts = [r["text"].split()[:300] for r in d.orderBy("doc_id").collect() if len((r["text"] or "").split()) >= 60]
    items = [(r["item_id"], r["text"]) for r in b.collect()]
    items += [(1000 + i, " ".join(t.split()[:n])) for i, t in items for n in [int(g.integers(5, 20))]]
    wanted, rows = set(), []
    for i, text in items:
        item, n = decontam.Item(i, text), len(text.split())
        for lost, added in ((0, 0), (0.12, 0), (0.24, 0), (0.38, 0), (0, 0.5), (0, 0.9), (0.2, 0.5)):
            host, words = hosts[int(g.integers(len(hosts)))], text.split()
            other = hosts[int(g.integers(len(hosts)))]
            for j in g.choice(n - n // 3, int(lost * n), replace=False) if lost else ():
                words[j] = other[int(g.integers(len(other)))]
            for j in sorted(g.integers(1, n, int(added * n)).tolist(), reverse=True):
                words.insert(j, other[int(g.integers(len(other)))])
            at = int(g.integers(len(host)))
            rows.append((10**6 + len(rows), " ".join([*host[:at], *words, *host[at:]])))
            flat = np.frombuffer(decontam._hashes(rows[-1][1]), "<u4")
            if any(decontam.verdict(item, flat[s : s + 2 * len(item.words)])[0] for s in range(len(flat))):
                wanted.add((rows[-1][0], i))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(spark, rows).select("doc_id", "text").unionByName(d.select("doc_id", "text")), benchmark).collect()}
    print("places held", len(wanted), "found", len(wanted & found))
    assert len(wanted) > 300 and wanted <= found


def test_a_small_share_still_fits_the_index(spark, monkeypatch):
    d, b = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = {r["doc_id"] for r in decontam.leaks(d, b).collect()}
    monkeypatch.setattr(decontam, "FIT_DOCUMENTS", 20)
    assert {r["doc_id"] for r in decontam.leaks(d, b).collect()} == want
    monkeypatch.setattr(decontam, "FIT_DOCUMENTS", 0)
    with pytest.raises(ValueError, match="no passage"):
        decontam.leaks(d, b)


def test_the_index_is_fitted_on_all_documents(spark, monkeypatch):
    d = spark.range(20_600).selectExpr("id as doc_id", "concat_ws(' ', 'a', 'b', hash(id) % 50, id % 7) as text")
    seen, real = [], decontam.gram_sketch
    monkeypatch.setattr(decontam, "gram_sketch", lambda words, *more: seen.append(words.count()) or real(words, *more))
    decontam.projection(decontam.word_table(d))
    assert seen == [20_600]


def test_sketch_of_the_gram_matrix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 3000)) for i, n in enumerate([0, 1, 63, 64, 65, 129, 1000, 4000])]
    idf = rng.random(decontam.FEATURES) * 8 + 0.1
    omega = decontam.sketch_matrix().astype(float)
    want = np.zeros((decontam.FEATURES, decontam.RANK))
    for _, text in rows:
        f = np.frombuffer(decontam._hashes(text), "<u4") % decontam.FEATURES
        for at in range(0, len(f), decontam.PASSAGE):
            part = f[at : at + decontam.PASSAGE]
            # a word that stands twice weighs twice, and the length is that of its words
            a = np.bincount(part, minlength=decontam.FEATURES) * idf
            want += a[:, None] * (a @ omega) / (idf[part] ** 2).sum()
    got = decontam.gram_sketch(decontam.word_table(docs(spark, rows)), idf)
    assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()


def test_a_passage_of_a_long_item_is_a_leak(spark):
    words = [f"q{i}x" for i in range(200)]
    host = " ".join(f"h{i}" for i in range(300))
    rows = [(1, f"{host} {' '.join(words[50:130])} {host}"), (2, f"{host} {' '.join(words[50:70])} {host}"), (3, f"{host} {' '.join(words)}")]
    found = {r["doc_id"]: r for r in decontam.leaks(docs(spark, rows), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()}
    assert sorted(found) == [1, 3] and found[1]["lcs_share"] == 0.4 and found[3]["lcs_share"] == 1.0


def test_common_subsequence():
    g = np.random.default_rng(9)
    for _ in range(50):
        a, b = g.integers(0, 6, 15).astype("<u4"), g.integers(0, 6, 25).astype("<u4")
        table = np.zeros((16, 26), int)
        for i in range(15):
            for j in range(25):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_subsequence(a, b) == table[15, 25]


CLASH = "rid removed item_ids lcs_share kept n_items host words row id key doc_key cid node".split()


def stage_results(spark, table):
    """Each stage on the same rows, with columns of the caller's that have the operators' own names."""
    plain = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    crowded = plain.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        yield name, plain.columns, stage(spark, plain, FOLDER), stage(spark, crowded, FOLDER)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_with_clashing_columns(spark, rows):
    table = [(d, t, None, None, None) for d, t in rows] + [(100 + i, f"{LONG} own{i} text{i}", "en", "s", 7) for i in range(3 if rows else 0)]
    for name, columns, a, b in stage_results(spark, table):
        got = b.collect()
        assert Counter(map(tuple, a.collect())) == Counter(tuple(r[c] for c in columns) for r in got), name
        if name != "repeated substrings":
            assert b.columns == [*columns, *CLASH]
            assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASH), name
        assert rows or not got


def test_rules_leave_lines_without_words(spark):
    blank = "\u00a0\u2003"
    body = lambda i: " ".join(f"t{i}_{j}" for j in range(60))
    assert rules.without_lines(f"{blank}\nx", {rules.line_key(blank.encode())}) == "x"
    out = rules.apply_quality_rules(docs(spark, [(i, f"{blank}\n{body(i)}\n \t") for i in range(30)])).collect()
    assert sorted(r["text"] for r in out) == sorted([f"{blank}\n{body(0)}\n \t", *(f"{body(i)}\n \t" for i in range(1, 30))])


def test_long_conversations_and_an_empty_table(spark):
    rows = [(1, i, "user" if i % 3 == 0 else "assistant", f"\ufeffé<{i}#") for i in range(5000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("formatted", F.lit(1))
    back = chat.read_back(chat.format_conversations(given)).collect()[0]
    assert [tuple(t) for t in back["turns"]] == [r[2:] for r in rows] and back["loss_text"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert chat.read_back(chat.format_conversations(given.limit(0))).count() == 0


def test_pipeline_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "text").collect()]
    kept = [(d, t) for (d, _, _), (ok, t) in zip(rows, brute_rules(rows)) if ok]
    kept = [r for r, n in zip(kept, near(kept, 5, 80)) if n[3]]
    kept = [(d, x.decode("utf-8", "ignore")) for (d, _), (x, _, _) in zip(kept, repeats(kept))]
    leaked = held_items(kept, [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    kept = [(d, t) for d, t in kept if d not in leaked]
    ranks = bpe.load_ranks(bpe.read_vocabulary(queries.BYTE_VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {d: (len(library.encode_ordinary(t)), sha(t.encode())) for d, t in kept}


def test_first_by_hash_is_the_sort_with_a_limit(spark):
    d = spark.range(40_000).withColumnRenamed("id", "doc_id")
    want = [r["doc_id"] for r in d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(500).collect()]
    assert [r["doc_id"] for r in common.first_by_hash(d, "doc_id", 500, 40_000).collect()] == want
    assert common.first_by_hash(d.where("doc_id < 9"), "doc_id", 500, 9).count() == 9 and common.first_by_hash(d.limit(0), "doc_id", 500, 0).count() == 0
