"""Small cases of the operators that look at one text at a time: nulls, empty and very long texts, ties, extra columns."""

import random
import re
import struct
import time

import pytest
from pyspark.sql import functions as F

from looma.llm import bpe, decontaminate, html_extract, langid, pii, toxicity, url_filter
from looma.llm.registry import ORACLES, QUERIES
from tests.oracle import same


def docs(spark, texts, first=0):
    """Documents with columns whose names clash with those of results."""
    rows = [(first + i, t, "en", "s", None if t is None else len(t), -1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, ids string")


EDGE = [None, "", " \n\t", "a", "Ünï çödé 漢字 🙂", "x" * 200_000, "word " * 30_000, "a", "a"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    same(QUERIES[name](spark, data), ORACLES[name], data)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.vocabulary()), bpe.Codec(bpe.vocabulary())
    rng = random.Random(1)
    letters = "abcthe isΣσςİßéÉ́̀ñ'st'rell123²Ⅷ٣½!?.-_  \n\t\x1c\x1f\x85\xa0​漢字🙂<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, "<|endoftext|>x<|startoftext|>", *[e for e in EDGE if e]]
    for s in texts:
        e = t.encode(s, add_special_tokens=False)
        ids = c.encode(s)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == e.ids
        assert c.decode(ids) == t.decode(e.ids, skip_special_tokens=False)
    out = bpe.token_digests(docs(spark, EDGE)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in out[:3]] == [0, 0, 0] and len(out) == len(EDGE)
    assert bpe.encode_texts(docs(spark, ["Hello there"])).first()["decoded"] == "hello</w> there</w>"
    assert bpe.token_digests(docs(spark, EDGE).limit(0)).count() == 0


def test_bpe_takes_code_points_as_the_library_does():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.vocabulary()), bpe.Codec(bpe.vocabulary())
    points = [0x558, 0x88F, 0x1C89, 0xA7CB, *range(0x80, 0x110000, 17)]
    for i in range(0, len(points), 500):
        s = " ".join(f"a{chr(p)}1{chr(p)}" for p in points[i : i + 500] if not 0xD800 <= p < 0xE000)
        assert c.encode(s) == struct.pack(f"<{len(e := t.encode(s, add_special_tokens=False).ids)}I", *e)


def test_small_vocabulary_scan_equals_heap():
    c = bpe.Codec(bpe.vocabulary())
    rng = random.Random(2)
    for _ in range(300):
        parts = [c.chars[ord(x)] for x in "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 80)))]
        assert c._scan(list(parts)) == c._heap(list(parts))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    seeds = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (222) 555-1234", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.2.3.4", "+1 (314) 555-6532 4663622617512349"]
    texts = [("x " + rng.choice(seeds) if i % 5 == 0 else "") + "".join(rng.choice("ab@@..+--  ()0123456789é\n") for _ in range(rng.randint(0, 50))) for i in range(3000)]
    for t in texts:
        want = sorted((m.start(), pii.KINDS.index(k), m.end()) for k, r in BASE.items() for m in re.finditer(r, t) if fits(k, m[0]))
        assert sorted((s, k, e) for k, s, e, base, _ in pii.candidates(t) if base) == want
    for t in ("0" * 5000 + ".1.1.1", "1." * 3 + "9" * 5000, "1" * 100_000, "a." * 50_000, "@" * 50_000, "+1" * 50_000, "1." * 50_000, "(at)" * 20_000):
        pii.candidates(t)


def test_pii_spans_are_the_same_found_and_redacted(spark):
    rng = random.Random(21)
    parts = ["212-555-0147", "(212) 555-0147", "call", "ssn", "078-05-1120", "GB82WEST12345698765432", "4111111111111111", "4111 1111 1111 1111", "+1 212 555 0147", "a@b.co", "a [at] b [dot] co", "10.0.0.1", "iban", "12", "."]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) if i % 3 else "".join(rng.choice(parts) for _ in range(rng.randint(1, 10))) for i in range(150)]
    d = docs(spark, texts)
    found = {r["doc_id"]: [*r["base"], *r["added"]] for r in pii.find(d).collect()}
    for r in pii.redact(d).collect():
        spans, out, at = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in found[r["doc_id"]])), [], 0
        for start, end, kind in spans:
            if start >= at:
                out += [texts[r["doc_id"]][at:start], f"<{kind}>"]
            at = max(at, end)
        assert r["text"] == "".join([*out, texts[r["doc_id"]][at:]])
    assert sum(len(v) for v in found.values()) > 500


def test_pii_spans_by_brute_force():
    rng = random.Random(22)
    for _ in range(300):
        base, loose = ([(s, s + rng.randint(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randint(0, 12)))] for _ in range(2))
        want, taken = [], -1
        clear = [x for x in sorted(loose) if not any(s < x[1] and x[0] < e for s, e in base)]
        for x in clear:
            if x[0] >= taken:
                want.append(x)
                taken = x[1]
        assert pii.clear_of(base, loose) == clear and pii.leftmost(clear) == want


def test_pii_is_linear_in_the_spans(spark):
    text = "call 212-555-0147, a@b.co; " * 50_000
    began = time.time()
    row = pii.find(docs(spark, [text])).first()
    assert time.time() - began < 60 and row["n_email"] == 50_000 and len(row["added"]) in (0, 50_000)
    began = time.time()
    pii.leftmost(pii.clear_of([(i, i + 3) for i in range(0, 10**6, 10)], [(i + 5, i + 8) for i in range(0, 10**6, 10)]))
    assert time.time() - began < 5


def test_pii_finds_and_redacts(spark):
    d = docs(spark, [*EDGE, "mail me: jo.doe@example.com or jo (at) example (dot) org", "call (314) 555-6532 now, host 10.1.2.3", "card 4111 1111 1111 1111, bad 4111 1111 1111 1112"])
    rows = {r["doc_id"]: r for r in pii.find(d).collect()}
    assert len(rows) == len(EDGE) + 3 and rows[9]["base"] == ["email:9:27"] and rows[9]["n_email"] == 1 and rows[10]["n_ip"] == 1 and rows[11]["n_card"] == 1
    assert rows[9]["added"] and rows[10]["added"] == ["phone:5:19"] and rows[0]["base"] == []
    clean = {r["doc_id"]: r for r in pii.redact(d).collect()}
    assert clean[9]["text"] == "mail me: <email> or <email>" and clean[9]["n_chars"] == len(clean[9]["text"])
    assert clean[11]["text"].startswith("card <card>, bad 4111") and clean[0]["text"] is None and clean[1]["text"] == ""
    kinds = lambda t: [pii.KINDS[k] for k, *_, valid in pii.candidates(t) if valid]
    assert kinds("DE89370400440532013000") == ["iban"] and "card" in kinds("4111111111111111") and kinds("123-45-6789") == ["ssn"]
    assert pii.redact(d).columns == d.columns and pii.find(d.limit(0)).count() == 0


EN = ["the cat and the dog with this thing that was here", "this is the house where they lived with their mother", "and then the other one was with them for the whole day"]
DE = ["der hund und die katze sind nicht in dem haus", "ich habe das nicht gewusst und er auch nicht", "die kinder spielen auf der strasse und lachen"]
FR = ["le chat et le chien ne sont pas dans la maison", "je ne savais pas que vous étiez avec elle dans le jardin", "les enfants jouent dans la rue et rient avec nous"]
ES = ["el gato y el perro no están en la casa de los niños", "no sabía que usted estaba con ella en el jardín", "los niños juegan en la calle y ríen con nosotros"]


def test_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(x, lang) for lang, xs in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)) for x in xs for _ in range(10)])]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model["names"] == ["de", "en", "es", "fr"] and model["families"] == ["germanic", "romance"]
    out = {r["doc_id"]: r for r in langid.predict(docs(spark, [None, "", "123 !!", "the dog and the cat", "der hund und das haus", "le chien dans la rue", "el perro en la calle", "x" * 100_000]), model).collect()}
    assert [out[i]["lang_pred"] for i in range(7)] == ["und", "und", "und", "en", "de", "fr", "es"] and all(0 <= r["score"] <= 1 for r in out.values())
    odd = langid.predict(docs(spark, ["²½①", "12 ² !", "² a"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, False]
    nothing = langid.fit(train.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(train, nothing).collect()} == {"und"}
    assert langid.predict(train.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(5)
    plain = ["house", "river", "garden", "window", "market", "paper", "stone", "bridge"]
    make = lambda bad: " ".join([rng.choice(plain) for _ in range(rng.randint(5, 80))] + ([rng.choice(["idiot", "moron"])] if bad else []))
    texts = [make(i % 4 == 0) for i in range(400)]
    d, labels = docs(spark, texts), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    held = [t for i, t in enumerate(texts)]
    p = toxicity.scorer(model)(held)
    assert sum((x >= 0.5) == (i % 4 == 0) for i, x in enumerate(p)) >= 395
    edge = toxicity.scorer(model)([None, "", "!!", "you idiott", "house " * 20_000])
    assert all(x < 0.5 for x in (edge[0], edge[1], edge[2], edge[4])) and edge[3] > edge[4]
    kept = toxicity.reject(d, model)
    assert kept.columns == d.columns and 295 <= kept.count() <= 305
    none = toxicity.fit(d, labels.limit(0))
    assert toxicity.score(d, none).where("score >= 0.5").count() == 0
    assert toxicity.score(d.limit(0), model).count() == 0


PAGE = """<html><head><title>T &amp; x</title></head><body class="has-sidebar"><header id="top"><a href=x>Home</a> Site</header><div class="cookie-notice">We use cookies.</div>
<div class="page ad-free"><main><article><header><h1>Head&nbsp;line</h1></header><p>One <i>two</i> three.<p>Four &lt; five <br> six<div class="ad">Buy!</div><ul><li>item a<li>item b</ul><form><label>Name</label><input></form><aside>Side</aside></article>
<section id="comments"><h2>Comments</h2><div class="comment">Nice post, really nice.</div></section></main></div><div class=sidebar>links</div><footer>(c)</footer></body></html>"""


def test_main_text(spark):
    assert html_extract.main_text(PAGE) == "Head line\nOne two three.\nFour < five six\nitem a\nitem b"
    for broken in (None, "", "<", "<p", "<!--", '<a "' * 20_000, "<div><p>a.</p>" * 5_000, "<" * 50_000):
        html_extract.main_text(broken)
    p = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (3, "u", "", 5)], "page_id long, url string, html string, n_chars int")
    out = {r["page_id"]: r for r in html_extract.extract(p, html_extract.fit(p)).collect()}
    assert out[1]["n_chars"] == len(out[1]["text"]) > 0 and out[2]["text"] == out[3]["text"] == ""
    assert html_extract.extract(p.limit(0), html_extract.fit(p.limit(0))).count() == 0


def test_main_text_keeps_what_belongs_to_the_article():
    page = lambda inner: f"<body><nav><a href=x>Menu</a></nav><article><p>First one is here.</p>{inner}<p>Last one is here.</p></article><footer>End</footer></body>"
    text = lambda inner: html_extract.main_text(page(inner)).split("\n")[1:-1]
    for inner, want in (
        ("<p>" + "İ" * 60 + "</p><script>x('<p>')</script><p>Next words.</p>", ["İ" * 60, "Next words."]),
        ("<p>Let <math><mi>x</mi></math> be it.</p><noscript><p>Plain words.</p></noscript>", ["Let x be it.", "Plain words."]),
        ("<object><p>An object.</p></object><p><svg><text>Label</text></svg> here.</p>", ["An object.", "Label here."]),
        ('<div class="article-header"><h1>Head</h1></div><div class="related-work"><p>Others did it.</p></div>', ["Head", "Others did it."]),
        ('<section class="search"><p>How to search.</p></section>', ["How to search."]),
        ('<div class="related-posts"><a href=x>More</a></div><div class="share-bar">Share</div><div id="adBox2">Buy</div>', []),
        ("<SCRIPT>a</SCRIPTX></script ><style>p</style><textarea>t</textarea><p>Seen.</p>", ["Seen."]),
        ("<p>a < b " * 150 + '<p title="x > y" class="k">Text here.</p>', ["a < b"] * 150 + ["Text here."]),
    ):
        assert text(inner) == want, inner[:80]


def test_minimum_cut_is_minimal():
    rng = random.Random(2)

    def cost(g, e, s):
        return sum(x if x > 0 else 0 for x, k in zip(g, s, strict=True) if not k) + sum(-x for x, k in zip(g, s, strict=True) if x < 0 and k) + sum(c for u, v, c in e if s[u] != s[v])

    for _ in range(200):
        n = rng.randint(1, 8)
        g, e = [rng.uniform(-2, 2) for _ in range(n)], [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(2 * n)]
        best = min(cost(g, e, [bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(best - cost(g, e, html_extract.minimum_cut(g, e))) < 1e-9


def test_urls(spark):
    urls = [None, "no scheme", "http://", "http://EXAMPLE.org/en/12?x#y", "https://a.example.org/es/", "http://x.com/fr/1", "http://x.com/de", "http://x.com/de/1", "ftp://h?q=/fr/", "http://x.com", "http://com/fr/"]
    p = spark.createDataFrame([(i, u, "clash", "rule") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(p).collect()}
    assert len(out) == len(urls) and out[0][:3] == ("", "", None) == out[1][:3]
    assert out[3] == ("example.org", "/en/12", "example.org/en/1", "block") and out[4] == ("a.example.org", "/es/", "example.org/es/", "block")
    assert out[5][2:] == ("com/fr/", "allow") and out[6][2] is None and out[7][2:] == ("com/de/", "block") and out[8][:2] == ("h", "") and out[9][1] == "" and out[10][2] == "com/fr/"
    assert url_filter.filter_urls(p.limit(0)).count() == 0


def test_lcs_and_leaks(spark):
    assert decontaminate.lcs(list("abcbdab"), list("bdcaba")) == 4 and decontaminate.lcs([], [1]) == 0
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)]
    fill = lambda n: " ".join(word() for _ in range(n))
    changed = " ".join(w if i % 5 else word() for i, w in enumerate(items[1].split()))
    texts = [*EDGE, fill(100) + " " + items[0].upper() + ". " + fill(50), fill(20) + " " + changed, fill(200), items[2]]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)] + [(90, None, 0), (91, "", 0)], "item_id long, text string, doc_id int")
    d = docs(spark, texts)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(d, bench).collect()} == {(9, 0), (10, 1), (12, 2)}
    kept = decontaminate.clean(d, bench)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {*range(9), 11}
    assert decontaminate.matches(d.limit(0), bench).count() == 0 and decontaminate.matches(d, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", (8, 30, 70))
def test_items_that_a_third_of_the_documents_hold(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    fill = lambda n: " ".join(word() for _ in range(n))
    items = [fill(size) for _ in range(3)]
    common = [word() for _ in range(12)]
    items.append(" ".join(rng.choice(common) for _ in range(size)))  # of words that nearly all documents hold
    texts, leaks = [], set()
    for i in range(300):
        text = [fill(rng.randrange(5, 80)), " ".join(rng.sample(common, 3)), fill(20)]
        if i % 3 == 0:
            text.insert(1, items[0])
            leaks.add((i, 0))
        if i % 100 == 50:
            text = [items[1]] if i == 50 else [*text, items[1], fill(9)]
            leaks.add((i, 1))
        if i % 100 == 70:
            text.insert(1, items[3])
            leaks.add((i, 3))
        texts.append(" ".join(text))
    d, bench = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(d, bench).collect()} == leaks
    assert {r["doc_id"] for r in decontaminate.clean(d, bench).collect()} == set(range(300)) - {i for i, _ in leaks}


def test_minimum_cut_of_many_doubtful_blocks():
    rng = random.Random(3)
    for n, spread in ((20_000, 1.0), (20_000, 0.2)):
        gain = [rng.uniform(-spread, spread) for _ in range(n)]
        edges = [(i - 1, i, 0.5) for i in range(1, n)] + [(i - 7, i, 0.7) for i in range(7, n, 7)]
        began = time.time()
        side = html_extract.minimum_cut(gain, edges)
        assert time.time() - began < 20 and len(side) == n  # about 2 s alone
    for _ in range(200):  # larger than what can be tried out: no single flip and no run of equal flips makes it cheaper
        n = 30
        gain = [rng.uniform(-1, 1) for _ in range(n)]
        edges = [(i - 1, i, 0.5) for i in range(1, n)] + [(i - 3, i, 0.7) for i in range(3, n, 3)]
        price = lambda s: sum(-g for g, x in zip(gain, s, strict=True) if (g < 0) == x and g < 0) + sum(g for g, x in zip(gain, s, strict=True) if g > 0 and not x) + sum(c for u, v, c in edges if s[u] != s[v])  # noqa: B023, E731
        side = html_extract.minimum_cut(gain, edges)
        own = price(side)
        for a in range(n):
            for b in range(a + 1, n + 1):
                for x in (True, False):
                    assert price(side[:a] + [x] * (b - a) + side[b:]) >= own - 1e-9


def test_html_keeps_what_stands_in_no_surroundings(spark):
    assert html_extract.main_text("<p>Hello</p>") == "Hello"
    assert html_extract.main_text("<nav>Menu</nav><p>Hello</p><footer>c</footer>") == "Hello"
    assert "Short lead." in html_extract.main_text("<article><h1>News</h1><p class='teaser'>Short lead.</p><p>And a long sentence about it, with all there is to say.</p></article>")
    big = "<article>" + "<p>word word word.</p>" * 20_000 + "</article><nav>x</nav>"
    rows = [(i, "u", big if i % 2 else PAGE) for i in range(12)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert (html_extract.fit(p, max_chars=20_000) != html_extract.WEIGHTS).any()  # pages that do not fit are left out, not the rest


def test_html_long_pages_have_the_same_grammar():
    end = '<p title="a>b">One sentence here.</p><div data-x="a>b" class="comments"><p>Other words.</p></div>'
    want = [(t, e.comments) for t, e, _, _ in html_extract.blocks(end)]
    assert want == [("One sentence here.", False), ("Other words.", True)]
    assert [(t, e.comments) for t, e, _, _ in html_extract.blocks("<p>" + "a < b <3 " * 200 + "</p>" + end)][1:] == want
    # a tag whose end is quoted never ends; those before it are read as text, in linear time
    t = time.monotonic()
    assert html_extract.blocks('<p>x</p>' + "<a " * 50_000 + '="b>"')[0][0] == "x"
    assert html_extract.blocks("<p>x</p>" + "<a ='" * 50_000 + '="b>"')[0][0] == "x"
    assert time.monotonic() - t < 10
    rng = random.Random(3)
    for _ in range(3000):
        page = "".join(rng.choice(["<a ", "</p", "<", ">", "=", '"', "'", " ", "x", "3"]) for _ in range(rng.randrange(1, 25)))
        closing = html_extract._closing(page)
        for at in (i for i, c in enumerate(page) if c == "<" and html_extract.TAG.match(page, i)):
            assert closing(at) == (html_extract.TOKEN.match(page, at) is not None), (page, at)


def test_one_huge_training_text_ends_no_sample(spark):
    rng = random.Random(8)
    clean, bad = ["river", "stone", "morning", "garden", "window"], ["zgrumpf", "blorkat", "vexnit"]
    texts = [" ".join(rng.choices(clean, k=12) + (rng.choices(bad, k=3) if i % 2 else [])) for i in range(200)]
    d = docs(spark, texts)
    order = [r["doc_id"] for r in d.select("doc_id").orderBy(F.xxhash64("doc_id")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).collect()]
    texts[order[0]] = (texts[order[0]] + " ") * 200
    d = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "xx").otherwise("en"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.fit(d, labels, max_chars=16_000)).collect()}
    assert sum((scores[i] >= 0.5) == (i % 2 == 1) for i in scores) > 190
    assert langid.fit(d, max_chars=16_000)["names"] == ["en", "xx"]
    many = d.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 66).cast("string")))
    assert len(langid.fit(many, max_chars=100_000)["names"]) == 66
