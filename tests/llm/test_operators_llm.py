"""Training-data operators against brute force, SQL and defined edge cases."""

import collections
import hashlib
import html.parser
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from boardlake.llm import (decontam, html_text, lm_score, mixing, ngram_join, pii, quality, quality_rules, token_files, toxicity,
                           wordhash as wh)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, short, repeated rows, null ids; extra columns named like internal ones.
EDGE = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7),
        (None, "a b c a b c a b c", "en", None, 17), (5, "One Two", None, "b", 7), (6, "x" * 30000, "en", "b", 30000), (7, "é ü 😀 word. " * 300, "fr", "c", 1)]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    for c in ("rep", "n", "h", "chunk", "bucket", "score", "label", "dc_key", "dc_bad", "dc_doc", "nj_gone", "nj_id", "nj_row", "nj_count", "mx_doc", "mx_size", "features", "cands"):
        df = df.selectExpr("*", f"'clash' as {c}")
    return df


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def oracle(sql, documents, **tables):
    con = duckdb.connect()
    con.register("documents", documents.select("doc_id", "text", "source").toArrow())
    for name, t in tables.items():
        con.register(name, t.toArrow())
    return con.execute(sql)


def same_rows(df, cursor):
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=key) == sorted(cursor.fetchall(), key=key)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("seed", range(3))
def test_words_and_ngrams_like_regex(seed):
    rng = random.Random(seed)
    texts = [None, "", *("".join(rng.choice("aBé \n\t.9_") for _ in range(rng.choice([1, 5, 80]))) for _ in range(60))]
    for table, pattern in ((wh.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (wh.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        by_word = {}
        got = list(wh.words_of(pa.array(texts), table))
        flat = [x for t in texts for x in words(t, pattern)]
        assert [int(c) for w in got for c in w.counts] == [len(words(t, pattern)) for t in texts]
        for word, h in zip(flat, (int(x) for w in got for x in w.hashes)):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)
        grams = {}
        for w in got:
            g, r = wh.ngrams(w, 3, short=True)
            for i in range(len(w.counts)):
                ws = words(texts[w.first + i], pattern)
                want = [tuple(ws[j:j + 3]) for j in range(len(ws) - 2)] if len(ws) >= 3 else ([tuple(ws)] if ws else [])
                for a, h in zip(want, g[r == i].tolist(), strict=True):
                    assert grams.setdefault(a, h) == h


def test_quality_learns_and_scores_edges(spark, sf, edge):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.predicted == got.quality).mean() > 0.95
    out = quality.quality_scores(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert {r["held_out"] for r in out if r["doc_id"] == 4} == {zlib.crc32(b"4") % 3 == 1}
    assert quality.quality_scores(edge, labels.limit(0)).where("score = 0.5").count() == len(EDGE)
    assert quality.quality_scores(edge.limit(0), labels).count() == 0
    kept = quality.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.count() <= len(EDGE)


def components(rows, size=3, percent=90):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join_like_brute_force(spark, small):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    near = []
    for i in range(140):  # one large group of near copies, linked and not linked
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10 ** 6)}"
        near.append((10_000 + i, " ".join(w)))
    rows = near + [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_ngram_join_edges(edge):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(edge).collect()), key=str)
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got  # empty sets link with nothing
    assert got.count((4, 1, 4)) == 2 and (5, 1, 4) in got and (None, 3, None) in got
    kept = ngram_join.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"]
    assert ngram_join.similar_components(edge.limit(0)).count() == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_token_files_round_trip(spark, small, edge, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.default_vocabulary())
    more = spark.createDataFrame([(3, "It's <|endoftext|> 1²\x85x­ΑΣ ﬁ́"), (3, "It's")], "doc_id long, text string")
    docs = small.select("doc_id", "text").unionByName(more).unionByName(edge.select("doc_id", "text"))
    want = collections.Counter()
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = token_files.tokenized(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (r["doc_id"] or -1) >= last
        at, last = at + r["n_tokens"], (r["doc_id"] or -1)
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, path)
    one = token_files.read_tokens(spark, path).where("doc_id = 11")
    assert one.count() == 1 and "EqualTo(doc_id,11)" in one._jdf.queryExecution().toString()
    assert token_files.tokenized(edge.limit(0)).count() == 0


def test_encoder_like_whole_texts():
    from tokenizers import Tokenizer

    path = token_files.default_vocabulary()
    whole, encoder, rng = Tokenizer.from_file(path), None, random.Random(2)
    encoder = token_files.Encoder(open(path, encoding="utf-8").read())
    assert encoder.by_runs
    letters = [chr(i) for i in range(1, 0x180)] + list("'sdtllveremABCÉ.,;! \n") * 20
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([2, 20, 100])))
        assert encoder(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, ok?</div><article><h1>A &amp; B</h1>
<p><b>First  par&shy;t<br><p>Second, <a href="x">linked</a> text. &lt;ok&gt;<div class="ad">Buy, now!</div><section id="comments"><p>I, reader.</p></section>
</article><aside>Side. Bar.</aside><form><p>Name, please.</p></form><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    assert html_text.main_text(PAGE) == "A & B\nFirst par­t\nSecond, linked text. <ok>"
    bare = "<body><div id='menu'><a href=x>Home</a></div><div class='c'><h2>News</h2><p>One, two; three. And four, five.</p><p>Short.</p></div><div class=sidebar>Foo.</div></body>"
    assert html_text.main_text(bare) == "News\nOne, two; three. And four, five.\nShort."
    assert html_text.main_text("plain 1 < 2 <a href='x") == "plain 1 < 2"
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long text, " * 20000 + "</p>")]
    got = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 2 or r["page_id"] is None] == ["", ""]
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A long sentence, with marks; it goes on. " * 8


def test_html_structure_is_evidence():
    """Ratios decide on every page: article, main and class names raise or lower them."""
    cards = "".join(f"<article class=card><h3><a href=x>T{i}</a></h3><p>Short teaser, no more.</p></article>" for i in range(4))
    teasers = f"<body><nav><a href=/>Home</a></nav><div class=c><h1>Head</h1><p>{LONG}</p><p>Second, also here.</p></div>{cards}</body>"
    assert html_text.main_text(teasers) == f"Head\n{LONG.strip()}\nSecond, also here."
    linked = "<article><h2><a href=x>Linked title</a></h2><p>One sentence, two. Three here.</p><ul><li><a href=y>Rel</a></li></ul></article>"
    assert html_text.main_text(linked) == "Linked title\nOne sentence, two. Three here."
    wrapped = f"<form id=aspnet><div class='page search'><h2>Head</h2><p>{LONG}</p><nav><a href=x>Home</a></nav></div></form><footer>(c) x</footer>"
    assert html_text.main_text(wrapped) == f"Head\n{LONG.strip()}"
    titled = f"<div class=top>Site name.</div><div class='page search'><h2>Head</h2><p>{LONG}</p></div>"
    assert html_text.main_text(titled) == f"Site name.\nHead\n{LONG.strip()}"
    commented = f"<article><h1>A</h1><p>Short, but the text.</p><section id=comments><p>{LONG * 9}</p></section></article><div class=comments><p>{LONG * 9}</p></div>"
    assert html_text.main_text(commented) == "A\nShort, but the text."


class ArticleText(html.parser.HTMLParser):
    """What stands in a page's article element, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_html_article_text_of_every_page(spark, sf):
    """Articles of this table hold text only (h1, p, b, br), so all of it and nothing else is the main text; white space aside."""
    pages = spark.read.parquet(f"{sf}/../sf0.1/pages.parquet")
    bare = lambda t: "".join(t.split())
    want = collections.Counter((r["page_id"], bare("".join(ArticleText(r["html"]).parts))) for r in pages.collect())
    got = html_text.main_texts(pages).collect()
    assert len(got) == 2500 and collections.Counter((r["page_id"], bare(r["text"])) for r in got) == want


def test_quality_rules_like_sql(small, edge):
    same_rows(quality_rules.apply_rules(small), oracle(quality_rules.ORACLE, small))
    same_rows(quality_rules.apply_rules(edge), oracle(quality_rules.ORACLE, edge))
    assert quality_rules.apply_rules(edge.limit(0)).count() == 0
    order = quality_rules.cascade(small, quality_rules.rules())
    assert sorted(x[0] for x in order) == sorted(quality_rules.rules())
    assert [x[2] / x[1] for x in order] == sorted((x[2] / x[1] for x in order), reverse=True)


def test_mixing_like_sql(small, edge):
    same_rows(mixing.mixing_plan(small), oracle(mixing.ORACLE, small))
    same_rows(mixing.mixing_plan(edge), oracle(mixing.ORACLE, edge))
    assert mixing.mixing_plan(edge.limit(0)).count() == 0
    got = mixing.mixing_plan(small).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    assert abs(got.taken.sum() / (1.5 * got["size"].sum()) - 1) < 0.1
    plan = collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixing_plan(small.where("length(text) > 0")).collect()})
    mixed = mixing.mix_documents(small.where("length(text) > 0"))
    assert mixed.columns == small.columns
    assert collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == +plan
    assert mixing.mix_documents(edge).columns == edge.columns


def test_toxicity_learns_and_locates(spark, sf, edge):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.03
    found = toxicity.offending_sentences(docs, model).join(docs.select("doc_id", "text"), "doc_id").limit(200).collect()
    assert found and all(r["sentence"] == r["text"][r["start"]:r["end"]] for r in found)
    out = toxicity.toxicity_scores(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] < 0.01 for r in out if r["doc_id"] in (1, 2, 3))
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert toxicity.toxicity_scores(edge, labels.limit(0)).where("score >= 0.5").count() == 0
    assert toxicity.toxicity_scores(edge.limit(0), labels).count() == 0


def test_toxicity_sample_has_one_text_an_id(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: taken.append(sorted(zip(texts.to_pylist(), y.tolist()))))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:6]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"text {ids[0]}")] * 50 + [(ids[1], f"other {j}") for j in range(50)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), labels)
    toxicity.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), labels)
    assert len(taken[0]) == len(ids) and taken[0] == taken[1]


def test_decontamination_like_sql(spark, sf, small, edge):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    same_rows(decontam.contamination(small, items), oracle(decontam.ORACLE, small, benchmark=items))
    long = " ".join(f"t{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"pre {long} post", "s"), (2, " ".join(long.split()[37:47]), "s"), (3, " ".join(long.split()[37:46]), "s"),
                                  (4, "The CAT. the cat", "s"), (5, "a " * 3000, "s"), (None, None, None), (4, "The CAT. the cat", "s")], "doc_id long, text string, source string")
    own = spark.createDataFrame([("9", long), ("10", "cat"), ("10", "cat"), ("11", "a " * 50), (None, "the cat"), ("12", None), ("13", "!!")], "item_id string, text string")
    same_rows(decontam.contamination(docs, own), oracle(decontam.ORACLE, docs, benchmark=own))
    clean = decontam.clean_documents(docs, own)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "None"]
    assert decontam.contamination(edge, own.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(edge.limit(0), own).count() == 0 and decontam.clean_documents(edge, own).columns == edge.columns


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 75)])
def test_ngram_join_sizes_and_thresholds(spark, size, percent):
    rng, texts = random.Random(size), []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 120]))]
        for more in (0, 0.08, 0.11, 0.2, 0.24, 0.3, 0.4):
            texts.append(" ".join(base + [f"x{rng.randrange(9999)}" for _ in range(round(more * len(base)))]))
    sets = [{tuple(w[j:j + size]) for j in range(max(len(w) - size + 1, 1))} for w in map(words, texts)]
    up = list(range(len(sets)))
    for _ in sets:  # smallest label over links until nothing changes
        up = [min(up[j] for j, y in enumerate(sets) if 100 * len(x & y) >= percent * len(x | y)) for x in sets]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, size, percent).collect()}
    assert got == {i: (len(s), up[i]) for i, s in enumerate(sets)}
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs, size, percent).collect()) == sorted(set(up))


@pytest.mark.parametrize("k,w", [(5, 6)])
def test_winnowing_keeps_a_print_of_every_span(k, w):
    rng = np.random.default_rng(1)
    text = " ".join(f"x{i}" for i in rng.integers(0, 30, 500))
    (a,) = wh.words_of(pa.array([text]), wh.ALNUM_WORDS)
    kept = set(decontam.winnow(a).tolist())
    assert all(any(p in kept for p in range(s, s + w)) for s in range(500 - (k + w - 1) + 1))


def base_spans(t):
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (True, all(int(p or 0) <= 255 for p in m[0].split(".") if kind == 1), 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_like_brute_force_and_sql(spark, small, edge):
    rng = random.Random(4)
    letters = "aB9._%+-@ 1234.0()é😀\nDE"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([20, 300]))) for _ in range(300)]
    texts += ["1" * 20000, "a@b.c_d@e.f.g@h.i", "0000000255.1.1.1 256.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 +49 (0)30 123456-78",
              "iban DE89370400440532013000, XX82WEST12345698765432; ssn 123-45-6789, 987-65-4321 call 555-123-4567", "a@b.cc " * 1500]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(8)
    names = ["email", "ip", "card", "phone"]
    for r in pii.span_digests(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{n}"] for n in names] == [sum(x[1] == i for x in want) for i in range(4)]
        joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        if r["doc_id"] == len(texts) - 2:
            assert r["spans"] == "iban:5:27,ssn:57:68,ssn:70:81,tel:87:99"
    same_rows(pii.span_digests(docs), oracle(pii.ORACLE, docs))
    same_rows(pii.span_digests(small), oracle(pii.ORACLE, small))
    same_rows(pii.span_digests(edge), oracle(pii.ORACLE, edge))
    assert pii.span_digests(edge.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "mail a@b.org now")], "doc_id long, text string")
    assert pii.redacted(one).first()["text"] == "mail <email> now"


def test_pii_context_on_both_sides_of_the_whole_text(spark):
    """Every added kind is found in lists after one word and where the word follows; without a word it is not."""
    rng = random.Random(6)
    number = {"ssn": lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
              "tel": lambda: f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"}
    word = {"ssn": "Social", "tel": "mobile"}
    texts, want = [], []
    for kind in number:
        for _ in range(40):
            a, b, c = (number[kind]() for _ in range(3))
            texts += [f"é {word[kind]} {a}, {b} or {c}.", f"{a} ({word[kind]})", f"{a} {'x' * 40} {word[kind]}", f"{word[kind]} {'x' * 40} {a}", f"{a};{b} {word[kind]}"]
            want += [[a, b, c], [a], [], [], [a, b]]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in pii.personal_data(docs, "text").collect():
        assert [r["text"][x["s"]:x["e"]] for x in r["found"]] == want[r["doc_id"]], r["text"]
    same_rows(pii.span_digests(docs), oracle(pii.ORACLE, docs))


def test_lm_scores_like_sql(small, edge, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 1 << 16)
    monkeypatch.setattr(lm_score, "PARTITION_CHARS", 1 << 15)
    same_rows(lm_score.backoff_scores(small), oracle(lm_score.ORACLE, small))
    same_rows(lm_score.backoff_scores(edge), oracle(lm_score.ORACLE, edge))
    assert lm_score.backoff_scores(edge.limit(0)).count() == 0
    assert lm_score.backoff_scores(small, order=4).count() == small.count()
    wordless = edge.where("doc_id in (1, 2, 3)")
    same_rows(lm_score.backoff_scores(wordless), oracle(lm_score.ORACLE, wordless))
    short = edge.where("doc_id in (2, 4)")
    same_rows(lm_score.backoff_scores(short), oracle(lm_score.ORACLE, short))
