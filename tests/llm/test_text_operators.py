"""Chat formatting, personal data, quality rules, pages and pieces against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from weftline.llm import chat_format, html_text, pieces, pii, quality, queries
from weftline.llm.common import table

# ---- chat


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", None, "", "<|turn|>x<|end|>\n", "\\<\\|part|>\\\\", "<<SYS>> a\\", "<", "|<s", "\\|", "[/INST", "<|" * 50]
    rows = [(c, t, role, texts[(3 * c + t) % len(texts)], "x") for c in range(12) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", None, "a\nb<|"])]
    rows += [(99, 1, "user", "tie", "x"), (99, 1, "assistant", "tie", "x"), (99, 1, "assistant", "tie", "x"), (None, 0, "user", "lost", "x"), (98, None, "assistant", None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.read_back(chat_format.format_conversations(df))).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, role or "", x or "") for cc, t, role, x, _ in rows if cc == c)
        want[c] = [(role, x) for _, _, role, x in own]
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)


def test_chat_merges_and_masks(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(df).first()
    assert row["formatted"] == "<|turn|>user<|body|>a<|end|>\n<|turn|>assistant<|body|>b<|part|>c<|end|>\n"
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["b", "c"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_ties_go_by_the_text_itself(spark):
    df = spark.createDataFrame([(1, 0, "user", "<s>"), (1, 0, "user", "<a"), (1, 0, "user", "<|"), (1, 0, "user", "\\")], "conv_id long, turn long, role string, text string")
    row = chat_format.digest(chat_format.read_back(chat_format.format_conversations(df))).first()
    assert row["turns_sha256"] == hashlib.sha256("".join(f"user\n{x}\n" for x in sorted(["<s>", "<a", "<|", "\\"])).encode()).hexdigest()


def test_chat_long_conversation(spark):
    df = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    row = chat_format.digest(chat_format.read_back(chat_format.format_conversations(df))).first()
    assert row["n_turns"] == 20_000


# ---- personal data


def plain_spans(text):
    """The base definitions, by plain regular expressions."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def test_pii_base_spans_equal_plain_ones(spark, sf):
    rnd = random.Random(5)
    made = ["".join(rnd.choice("ab1.2@+-3 ()5\n:%") for _ in range(rnd.randrange(60))) for _ in range(4000)]
    real = [r["text"] for r in table(spark, sf, "documents").select("text").collect()]
    for text in [*made, *(t for t in real if t)]:
        assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == plain_spans(text)


def test_pii_hints_lose_no_match():
    """A text without the hints of a slow pattern has no match of it."""
    rnd = random.Random(6)
    parts = ["token", "TOKEN", "to\u212aen", "ſecret", "Secret", "apı-key", "API_KEY", "api key", "passwd", "PASSWORD", "=", ": ", " ", "'", "a1" * 9, "Zz9+/" * 5, "==", "1.2.3.4", "10.0", ".", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "X", "9"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 8)))
        spans = pii.find_spans(text)
        assert [s[1:3] for s in spans if s[0] == "ip"] == list(pii._ips(text))
        assert [s[1:3] for s in spans if s[0] == "iban"] == list(pii._ibans(text))
        assert [s[1:3] for s in spans if s[0] == "secret"] == [m.span(1) for m in pii._SECRET.finditer(text) if m.end(1) - m.start(1) >= 16]


def test_pii_checksums_context_and_redaction():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    text = "bank GB82 WEST 1234 5698 7654 32 token = \"abcdef0123456789abcdef\" mail a.b@c.de or 10.0.0.1"
    found = {k: (text[s:e], v) for k, s, e, v in pii.find_spans(text)}
    assert found["iban"][0] == "GB82 WEST 1234 5698 7654 32" and found["iban"][1] > pii.PRIOR["iban"]
    assert found["secret"][0] == "abcdef0123456789abcdef"
    assert pii.redact_text(text) == 'bank [IBAN] token = "[SECRET]" mail [EMAIL] or [IP]'
    assert pii.redact_text("nothing to see") == "nothing to see"


def test_pii_long_runs():
    assert [s[:3] for s in pii.find_spans("0" * 5000 + ".1.1.1 or 0." + "0" * 5000 + "256.1.1") if s[0] == "ip"] == [("ip", 0, 5006)]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"
    for key in (jwt, "k" * 30_000 + "9", "QUJDREVGR0hJSktMTU5PUA=="):
        assert pii.redact_text(f"token: {key}. More text") == "token: [SECRET]. More text"
    assert pii.redact_text("password = ........................") == "password = ........................"


def test_pii_query_equals_plain_digests(spark, sf, odd_docs):
    plain = [(r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").collect()]
    got = {r["doc_id"]: r for r in queries.op4_pii(spark, sf).collect()}
    got |= {("odd", r["doc_id"]): r for r in pii.digest(pii.detect(odd_docs.where("doc_id <> 6 and coalesce(length(text), 0) < 20000"))).collect()}
    plain += [(("odd", r["doc_id"]), r["text"] or "") for r in odd_docs.where("doc_id <> 6 and coalesce(length(text), 0) < 20000").collect()]
    assert len(got) == len(plain)
    for i, text in plain:
        want, r = plain_spans(text), got[i]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert len(r["spans"].split(",")) == len(r["scores"].split(","))


def test_pii_odd_rows(odd_docs, no_docs):
    got = pii.digest(pii.detect(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    redacted = pii.redact(odd_docs)
    assert redacted.columns == odd_docs.columns and redacted.count() == odd_docs.count()
    assert pii.detect(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


# ---- quality


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_base_counts_equal_plain_ones(spark, sf, odd_docs, no_docs):
    rnd = random.Random(3)
    made = [" ".join(rnd.choice(["a", "b", "c\n", "#x", "\x0b", "é"]) for _ in range(rnd.randrange(80))) for _ in range(500)]
    real = [r["text"] for r in table(spark, sf, "documents").select("text").limit(300).collect()]
    got, _ = quality.measure([t or "" for t in [*made, *real]])
    for i, t in enumerate([*made, *real]):
        assert tuple(got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_quality(t)
    rows = quality.assess(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4))
    assert quality.assess(no_docs).count() == 0 and quality.clean_documents(no_docs).columns == no_docs.columns


def test_quality_lines():
    good = "A plain sentence with enough words in it to be kept by all rules, and then some more of them so that most of this text stays."
    text = "\n".join([good, "Home | About | News | Contact", "Read more", "GO!! NOW!! BUY!! IT!!", "All rights reserved by us and others.", "a%%% b*** c### d$$$ e&&&", "Second line that also has a full stop."])
    got, clean = quality.measure([text, good, "bad%%% " * 30])
    assert clean[0] == good + "\nSecond line that also has a full stop." and clean[1] == good
    assert list(got["kept"]) == [True, True, False]


def test_quality_lines_of_navigation():
    for line in ("Home About News Contact Login", "Startseite Produkte Kontakt Impressum", "HOME  Shop\tOur Blog", "Accueil Recherche Aide Nous"):
        assert quality.line_fails(line.encode(), len(line.split())), line
    for line in ("Home is where the news about the shop is read", "Home, news and help.", "The support of a cart about to go home", "Search home help contact."):
        assert not quality.line_fails(line.encode(), len(line.split())), line


def test_quality_query_equals_its_sql_on_made_lines(spark):
    """The rules on lines that the given tables lack, against the SQL."""
    import duckdb

    rnd = random.Random(17)
    words = ["home", "About", "news", "login", "privacy policy", "click here", "Terms of Use", "a", "plain", "word.", "b!", "c", "d", "e|f", "#", "\n", "\n", "end.\n"]
    rows = [(i, " ".join(rnd.choice(words) if rnd.random() < 0.4 else f"w{rnd.randrange(999)}" for _ in range(rnd.randrange(60)))) for i in range(1500)] + [(1500, None), (1501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in quality.assess(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    connection = duckdb.connect()
    connection.register("documents", df.toPandas())
    assert got == sorted(connection.sql(quality.ORACLE).fetchall())
    assert 300 < sum(r[-1] for r in got) < 1400


def test_quality_keeps_long_lines_that_mention_boilerplate():
    words = [f"word{i}" for i in range(60)]
    for phrase in ("privacy policy", "Terms of Use", "click here"):
        one_line = " ".join([*words[:30], "our", phrase, *words[30:]]) + "."
        paragraphs = one_line + "\n" + " ".join(w[::-1] for w in words) + ".\nAll rights reserved."
        got, clean = quality.measure([one_line, paragraphs])
        assert clean == [one_line, paragraphs.rsplit("\n", 1)[0]]
        assert list(got["kept"]) == [True, True] and got["lost_chars"][0] == 0
    assert quality.line_fails(b"Read our privacy policy and our terms of use before you accept cookies on this site.", 16)
    assert quality.line_fails(b"Please click here to go to the next page.", 9)


def test_quality_keeps_labelled_good_documents(spark, sf):
    kept = quality.assess(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed and quality = 1")
    assert kept.where("kept").count() >= 0.97 * kept.count()


# ---- pages


def test_page_lines_and_differencing():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; line</h1><p>One  <b>bold</b>\n text.<br>more<p>Two &copy; 3&nbsp;km<div id=comments><p>Nice post</div></article>"
        "<aside>Side</aside><form>Name<input></form><script>var x='</p>';</script><footer>Foot</footer>"
    )
    assert html_text.main_text(html_text.page_lines(page), []) == "Head & line\nOne bold text. more\nTwo © 3 km"
    a = html_text.page_lines("<div>Site menu</div><div>Own text one</div><div>Shared foot</div>")
    b = html_text.page_lines("<div>Site menu</div><div>Other text</div><div>Shared foot</div>")
    assert html_text.main_text(a, [b]) == "Own text one"
    shared = html_text.page_lines("<article><p>Same passage</p><p>x</p></article>")
    assert html_text.main_text(shared, [html_text.page_lines("<article><p>Same passage</p><p>y</p></article>")]) == "Same passage\nx"


def test_marks_of_the_whole_page_are_not_furniture():
    page = "<html><body class='home has-sidebar'><div class=sidebar>Side</div><main class='with-sidebar'><p>Own<ol class=commentlist><li>Nice</ol></main></body></html>"
    assert html_text.main_text(html_text.page_lines(page), []) == "Own"


def test_marked_paragraphs_end_where_html_ends_them():
    def text(page):
        return html_text.main_text(html_text.page_lines(page), [])

    for mark in ("class=share", "class='notice'", 'id="related"', "role=complementary", "hidden"):
        assert text(f"<article><p {mark}>x</p><p>body 1</p><p>body 2</p></article>") == "body 1\nbody 2"
        assert text(f"<article><p {mark}>x<p>body 1<div>body 2</div></article>") == "body 1\nbody 2"
        assert text(f"<article><p {mark}>x<table><tr><td>body 1</table>body 2</article>") == "body 1\nbody 2"
        assert text(f"<article><ul><li {mark}>x<li>body 1<ul><li>body 2</ul></ul>body 3</article>") == "body 1\nbody 2\nbody 3"
        assert text(f"<dl><dt {mark}>x<dd>body 1</dl><table><tr {mark}><td>x<tr><td {mark}>x<td>body 2</table>") == "body 1\nbody 2"
    assert text("<div class=share><p>x</p>y</div><p>body</p>") == "body"
    assert text("<ul><li class=menu>x<ul><li>y</ul>z<li>body</ul>") == "body"
    assert text("<p>body 1<span hidden>x</p>body 2") == "body 1\nbody 2"


def test_marks_are_whole_words_of_containers():
    def text(page):
        return html_text.main_text(html_text.page_lines(page), [])

    for mark in ("class='content no-sidebar'", "class='social-history'", "id='related-work'", "class='adsorption'", "title='the hidden valley'", "style='overflow:hidden'", "data-id='menu'"):
        assert text(f"<article><div {mark}><p>body 1</p></div><p {mark}>body 2</p></article>") == "body 1\nbody 2"
    for mark in ("class='x cookie-notice'", "class=ad", "id=comments", "class='comment-list'", "class='site-header'", "role=search"):
        assert text(f"<article><div {mark}><p>x</p></div><p>body</p></article>") == "body"
    assert text("<header>Site</header><article><header><h1>Headline</h1></header><p>See the <a class='related' href=x>related case</a> too.</p><footer>x</footer></article>") == "Headline\nSee the related case too."


def test_differencing_decides(spark):
    """Templates that nothing but the neighbours tells from the text, with and without an article element."""
    def page(k, open_, close):
        return f"<div>Welcome to the site</div><span>Latest</span><div>Title {k}</div>{open_}<p>Text {k}</p><p>One shared passage</p>{close}<div>Made by us</div>"

    rows = [(k, f"http://h.org/a{k}", page(k, "<div>", "</div>")) for k in range(3)] + [(10 + k, f"http://i.org/a{k}", page(k, "<article>", "</article>")) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nText {k}" for k in range(3)} | {10 + k: f"Title {k}\nText {k}\nOne shared passage" for k in range(3)}
    apart = [(i, f"http://{i}.org/", h) for i, _, h in rows]
    alone = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(apart, "page_id long, url string, html string")).collect()}
    assert all("Welcome" in alone[k] for k in range(3)) and alone[10] == "Text 0\nOne shared passage"


def test_marks_are_read_from_attributes_of_that_name():
    page = (
        '<div style="overflow:hidden">one</div><div data-role="search">two</div><p title="class=share">three</p><p data-hidden>four</p>'
        "<p alt='a id=\"menu\" b'>five</p><p data-x=hidden>six</p>See <a title=\"hidden gems\">seven</a><div class=x/y>eight</div>"
    )
    want = ["one", "two", "three", "four", "five", "six", "See seven", "eight"]
    assert [t for t, _ in html_text.page_lines(page)] == want
    marked = "<div hidden>x</div><div\nCLASS = 'a share b'>x</div><div data-a='1'id=menu>x</div><div aria-hidden=true>x</div><p/hidden>x</p>own"
    assert [t for t, _ in html_text.page_lines(marked)] == ["own"]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        for cells in (1 << 16, 4):
            monkeypatch.setattr(html_text, "CELLS", cells)
            got = html_text.aligned(a, b)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_alignment_of_many_equal_lines():
    a, b = (["x", "y", "x", "x", "z"] * n for n in (1200, 1100))
    assert len(html_text.aligned(a, ["new", *b, "end"])) == 5500


def test_pages_equal_the_article(spark, sf):
    import html

    rows = {r["page_id"]: r["text"] for r in queries.op6_html_text(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body.group(1))]
        assert rows[r["page_id"]] == "\n".join(x for x in blocks if x)


def plain_main_texts(rows):
    """Texts by page id: each page against the nearest pages of its host with other lines, and any, on both sides."""
    lines = {i: html_text.page_lines(page or "") for i, _, page in rows}
    order = sorted(rows, key=lambda r: (r[1].split("//")[1].split("/")[0], r[1].split("//")[1].split("?")[0], r[1], r[0]))
    hosts = [r[1].split("//")[1].split("/")[0] for r in order]
    out = {}
    for at, (i, _, _) in enumerate(order):
        near = []
        for side in (range(at - 1, -1, -1), range(at + 1, len(order))):
            near += [lines[order[k][0]] for k in side if hosts[k] == hosts[at] and lines[order[k][0]] not in ([], lines[i])][:1]
        out[i] = html_text.main_text(lines[i], near)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_pages_meet_the_nearest_other_page_of_their_host(spark, partitions):
    rnd = random.Random(partitions)
    rows = []
    for host in ("a.org", "b.org", "é.org"):
        for k in range(12):
            page = f"<div>Menu of {host}</div><div>Own text {k} of {host}</div>" if rnd.random() < 0.7 else rnd.choice(["", None, "<nav>Menu</nav>"])
            rows += [(len(rows) + c, f"http://{host}/p{k:02}?utm={c}", page) for c in range(rnd.choice([1, 5, 9]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_text.extract(df, partitions).collect()}
    assert got == plain_main_texts(rows)
    assert not any("Menu" in x for x in got.values())


def test_pages_odd_rows(spark):
    rows = [(1, "http://h/a", None, "x"), (2, None, "<p>Alone", "x"), (None, "http://h/b", "plain text", "x"), (3, "http://h/c", "", "x"), (4, "http://h/d", "<p>" + "long " * 100_000, "x")]
    rows += [(5, "http://h/same", "<div>copy of a page</div>", "x")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df, 1).collect()
    assert len(got) == len(rows) and [r["text"] for r in got if r["page_id"] == 5] == ["copy of a page"] * 3
    assert {r["text"] for r in got if r["page_id"] in (1, 3)} == {""}
    assert html_text.extract(df.limit(0)).count() == 0


# ---- pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, sf, library):
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(9)
    made = ["".join(rnd.choice("  aeiostTh\n▁é你🙂-=.0'\t\x01") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    made += ["a" * 3001, "ab" * 2000, " " * 333, "=" * 1000, "ha" * 999 + " ", "\n\n\n", " x", "x ", "▁", "the" * 700, "0123456789" * 300]
    real = [r["text"] or "" for r in table(spark, sf, "documents").select("text").collect()]
    flat, counts = model.encode_batch([*made, *real])
    at = 0
    for text, n in zip([*made, *real], counts, strict=True):
        ids = flat[at : at + n].tolist()
        at += n
        assert ids == library.encode(text), repr(text[:80])
        assert model.decode(ids) == library.decode(ids), repr(text[:80])


def test_pieces_of_long_words(library):
    """Without any space: random letters, letters of one kind with others, and repeats, far beyond a usual word."""
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(10)
    made = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aab", "the", "0123456789", "é🙂你-=") for n in (257, 600, 5000)]
    made += ["a" * 5000, "ab" * 3000, "abc" * 700 + "a" * 900, "=" * 4000, "ha" * 3000]
    flat, counts = model.encode_batch(made)
    for text, ids in zip(made, [x.tolist() for x in np.split(flat, counts.cumsum()[:-1])], strict=True):
        assert ids == library.encode(text), text[:40]


def test_pieces_query_equals_library_digests(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op8_pieces(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        ids = library.encode(r["text"] or "")
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_odd_rows(odd_docs, no_docs, library):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(odd_docs, path), path).collect()}
    for r in odd_docs.where("doc_id is not null").collect():
        ids = library.encode(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids) and got[r["doc_id"]]["text"] == library.decode(ids)
    assert pieces.encode(no_docs, path).count() == 0
