"""Operators that judge each text on its own: BPE, HTML, quality, secrets."""

import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import regex
from conftest_llm import by_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetpulse.llm import bpe, html, quality, secrets
from fleetpulse.llm.common import table


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# --- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(bpe.vocabulary_path())


def library_row(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())


def test_bpe_equals_library_on_documents(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    want = [library_row(library, r.doc_id, r.text) for r in docs.collect()]
    assert by_rows(bpe.bpe_encoding(docs)) == sorted(want, key=repr)


def test_bpe_messy_and_empty(messy, no_documents, library):
    want = [library_row(library, r.doc_id, r.text) for r in messy.collect()]
    assert by_rows(bpe.bpe_encoding(messy)) == sorted(want, key=repr)
    assert bpe.bpe_encoding(no_documents).count() == 0


ODD = st.text(st.sampled_from("aAbéÉßÜſİıΣσς'’`́̈가 \t\x1c\x85\xa0　日🙂$%!.,-_012½Ⅷ<|>ﬁǅK\x00"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ODD, st.sampled_from(["", "<|endoftext|>", "<|startoftext|>x", "'ll've", "aaaaaaaaaaaa", "!!!!!!!!!"]))
def test_bpe_equals_library_on_odd_texts(library, own, text, tail):
    assert np.frombuffer(own.encode(text + tail), "<u4").tolist() == library.encode(text + tail, add_special_tokens=False).ids


def test_bpe_equals_library_on_every_assigned_code_point(library, own):
    """Beside letters, digits and signs, and doubled; also a part of the code points that nobody has assigned."""
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    chosen = [c for k, c in enumerate(every) if k % 23 == 0 or not regex.match(r"\p{Cn}|\p{Co}", c)]
    assert len(chosen) > 150_000 and len(bpe.young_ranges()) > 1
    for k in range(0, len(chosen), 5000):
        texts = [f"a{c}b!{c}? 7{c}{c}" for c in chosen[k : k + 5000]]
        for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == e.ids, ascii(text)


def test_bpe_ids_column(spark, messy, library):
    got = {r.doc_id: r.x for r in messy.select("doc_id", bpe.encoded(messy.text, bpe.vocabulary_path())["ids"].alias("x")).collect()}
    assert got[10] == library.encode(next(r.text for r in messy.collect() if r.doc_id == 10), add_special_tokens=False).ids


# --- HTML


#: What browsers never show, told here apart from the operator's own lists.
NEVER_SHOWN = (
    "script style template head title noscript iframe noembed noframes object audio video canvas datalist map rp".split()
)


class Words(HTMLParser):
    """Visible words of a page without hidden elements, in order."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in NEVER_SHOWN

    def handle_endtag(self, tag):
        self.skip -= tag in NEVER_SHOWN and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_html_keeps_every_visible_word(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html.html_extraction(pages).collect():
        parser = Words()
        parser.feed(sources[r.page_id])
        parser.close()
        # Layout marks and blanks between tags apart, the same characters in the same order.
        plain = re.sub(r"[\s|]|(?m:^\s*(?:- |\d+\. ))", "", r.text)
        assert re.sub(r"[\s|-]", "", plain) == re.sub(r"[\s|-]", "", "".join(parser.out)), r.page_id
        assert (r.n_chars, r.n_words) == (len(r.text), len(r.text.split()))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("a<b>b</b> c&amp;d&nbsp;", "ab c&d"),
        ("<ul><li>x<ul><li>y</ul><li>z</ul>", "- x\n  - y\n- z"),
        ("<ol start=3><li>a<li>b<br>c</ol>", "3. a\n4. b\n   c"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
        ("<table><td>a<td>b<tr><td colspan=2>long one</table>", "a | b\nlong one"),
        ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        | y\n         |\nin | ner |"),
        ("x<script>var a='<p>';</script><style>p{}</style>y", "xy"),
        ("<p hidden>n<p style='Display : NONE'>n<p>y<template>n</template>", "y"),
        ("<details><summary>s</summary>n</details><details open><summary>s</summary>y</details>", "s\ns\ny"),
        ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("1 < 2 <!-- c -->&lt;p&gt;<!-- open", "1 < 2 <p>"),
        ("a<br><br>b", "a\n\nb"),
        ("</p>x</div></table>y", "xy"),
        ("<a href=\"x", ""),
        ("", ""),
    ],
)
def test_html_layout(page, text):
    assert html.extract(page).strip("\n") == text.strip("\n")


@pytest.mark.parametrize(
    "page, text",
    [
        ('a<img alt="5" screen">b "c" d', 'ab "c" d'),
        ("<a title=John's>a</a> and Jane's <b>c</b>", "a and Jane's c"),
        ('<table><tr><td width=10">a<td>b</table><p>c', "a | b\n\nc"),
        ("<p>a</p '>b<p>c", "a\n\nb\n\nc"),
        ("<p>a</p x=\"y>z\">b", "a\n\nb"),
        ('<a "x>a</a>b', "ab"),
        ('<a x = "1>2"y=\'3>4\'>a', "a"),
        ("<a x=>a", "a"),
        ("<a x=1>2", "2"),
        ("<a =x>a", "a"),
        ('<p title=">" hidden>n<p title=it"s hidden>n<p "hidden>y', "y"),
        ('a<a href="x>b', "a"),
    ],
)
def test_html_stray_quotes(page, text):
    assert html.extract(page).strip("\n") == text


HIDDEN = "script style template head title noscript iframe noembed noframes object audio video canvas datalist map".split()


@pytest.mark.parametrize("tag", HIDDEN)
def test_html_hides(tag):
    assert html.extract(f"<p>a<{tag}>n</{tag}>b").strip() in ("ab", "a b", "a\nb")


@pytest.mark.parametrize(
    "page, text",
    [
        ("a<dialog>n</dialog>b<dialog open>c</dialog>", "ab\nc"),
        ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr"),
        ("<div style='visibility:hidden'>n<b style='visibility: visible'>y<i>z</i></b>n</div>w", "yz\nw"),
        ("<p style='visibility:hidden'>n<span style='visibility:inherit'>n</span></p>y", "y"),
        ("<ul style='visibility:collapse'><li>n<li style='visibility:visible'>y</ul>", "- y"),
        ("<form><input type=submit value='Send it'><input type=text value=n><input type=hidden value=n></form>", "Send it"),
        ("<p style='--x:display:none'>y<p style='content:\"display:none\"'>z", "y\n\nz"),
        ("<p style='display:none;display:block'>y<p style='display:none !important;display:block'>n", "y"),
        ("<p style='/* ; */ display : NONE'>n<p style='background:url(a;display:none)'>y", "y"),
        ("<p style='display'>y<p style=';;display:;'>z<p style='display:none'", "y\n\nz"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol><li>a<li value=9>b<li>c<li value=x>d</ol>", "1. a\n9. b\n10. c\n11. d"),
        ("<ol start=-1><li>a<li>b<li>c</ol><ol reversed start=5><li>a<li>b</ol>", "-1. a\n0. b\n1. c\n\n5. a\n4. b"),
    ],
)
def test_html_visibility_and_numbers(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("tag", "svg math b a span unknown figure section summary text".split())
def test_html_shows(tag):
    assert html.extract(f"a<{tag}>y</{tag}>b").split() in (["ayb"], ["a", "y", "b"])


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"),
        ("<math><semantics><mi>x</mi><annotation>n</annotation><annotation-xml><mi>n</mi></annotation-xml></semantics></math>", "x"),
        ("<math><mtable><mtr><mtd>1<mtd>2</mtr><mtr><mtd>3</mtd><mtd>4</mtd></mtr></mtable></math>", "1 2\n3 4"),
        ("<svg><title>n</title><desc>n</desc><metadata>n</metadata><defs><text>n</text></defs><text>Jan</text><text>Feb</text></svg>", "Jan\nFeb"),
        ("<svg><title/><defs/><style/><path d=/x/ /><text>y</text></svg>z", "y\nz"),
        ("<svg><script>n</script><style>n</style><text>y<tspan> z</tspan></text></svg>", "y z"),
        ("<svg><text><![CDATA[a <b> & c]]></text></svg><![CDATA[n]]>", "a <b> & c"),
        ("<svg><defs><path><p>y", "y"),
        ("<svg><foreignObject><p>a<p>b</foreignObject><text>c</text></svg>", "a\n\nb\n\nc"),
        ("<svg hidden><text>n</text></svg>y", "y"),
        ("<desc>y</desc><metadata>z</metadata>", "yz"),
    ],
)
def test_html_formulas_and_drawings(page, text):
    assert html.extract(page).strip("\n") == text


@pytest.mark.parametrize(
    "rows, text",
    [
        ("<tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e", "a | b\n  | c\nd | e"),
        ("<tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e", "a | b | c\nd |   | e"),
        ("<tr><td>a<td rowspan=0>b<tr><td>c<tr><td>d<td>e", "a | b\nc |\nd |   | e"),
        ("<tr><td rowspan=3 colspan=2>a<td>b<tr><td>c<tr><td>d", "a   | b\n    | c\n    | d"),
        ("<thead><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d", "a | b\nc | d"),
        ("<tr><td rowspan=2>a<td rowspan=3>b<td>c<tr><td>d<tr><td>e<td>f", "a | b | c\n  |   | d\ne |   | f"),
        ("<tr><td>a<td rowspan=2>b<tr><td colspan=2>c", "a | b\n  |   | c"),
        ("<tr><td rowspan=x>a<td>b<tr><td>c", "a | b\nc"),
    ],
)
def test_html_rowspans(rows, text):
    assert html.extract(f"<table>{rows}</table>").strip("\n") == text


def test_html_deep_and_null(spark):
    assert html.extract("<div>" * 50_000 + "x") == "x"
    pages = spark.createDataFrame([(1, None, None, "z"), (None, "u", "<p>a", "z"), (1, None, None, "z")], "page_id long, url string, html string, text string")
    assert by_rows(html.html_extraction(pages)) == sorted([(1, None, "", 0, 0, 0)] * 2 + [(None, "u", "a", 1, 1, 1)], key=repr)
    assert html.html_extraction(pages.limit(0)).count() == 0


# --- Quality


def plain_quality(text, ratio=None):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for k, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def plain_ratios(docs, trusted):
    """log ratios from dictionaries of trigrams."""
    raw, good = Counter(), Counter()
    for doc_id, text in docs:
        b = b" " + text.encode().lower() + b"  "
        n = Counter(((int.from_bytes(b[k : k + 3], "little") * 2654435761) & 0xFFFFFFFF) >> 17 for k in range(len(b) - 2))
        raw.update(n)
        if doc_id in trusted:
            good.update(n)
    tg, tr = sum(good.values()), sum(raw.values())
    if not tg:
        return lambda k: 0.0
    size = quality.BUCKETS
    return lambda k: float(np.log((good[k] + 1) / (tg + size)) - np.log((raw[k] + 1) / (tr + size)))


def plain_verdicts(docs, trusted):
    ratio = plain_ratios(docs, trusted)
    out = []
    for doc_id, text in docs:
        b = b" " + text.encode().lower() + b"  "
        keys = [((int.from_bytes(b[k : k + 3], "little") * 2654435761) & 0xFFFFFFFF) >> 17 for k in range(len(b) - 2)]
        score = sum(map(ratio, keys)) / len(keys)
        base = plain_quality(text)
        out.append((doc_id, *base, not base[-1] and score >= quality.THRESHOLD, round(score, 9)))
    return out


@pytest.mark.parametrize("which", ["documents", "messy", "messy without labels"])
def test_quality_equals_brute_force(spark, sf_dir, messy, labels, no_labels, which):
    docs, own = (table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")) if which == "documents" else (messy, labels if which == "messy" else no_labels)
    trusted = {r.doc_id for r in own.collect() if r.quality == 1 and r.doc_id is not None}
    want = plain_verdicts([(r.doc_id, r.text or "") for r in docs.collect()], trusted)
    got = [(*r[:-1], round(r[-1], 9)) for r in quality.quality_rules(docs, own).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_rejects_labelled_junk(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    kept = quality.quality_rules(table(spark, sf_dir, "documents"), labelled).join(labelled, "doc_id")
    rows = kept.select("quality", "kept", "base_failed").collect()
    assert not [r for r in rows if r.kept and not r.quality]
    assert not [r for r in rows if r.quality and not r.kept and not r.base_failed]


def test_quality_empty_table(no_documents, no_labels):
    assert quality.quality_rules(no_documents, no_labels).count() == 0


def test_repeat_words_of_long_lists():
    words = [b"a", b"b", b"c", b"d"] * 2 + [str(k).encode() for k in range(50)]
    assert quality.repeat_words(words) == 8
    assert quality.repeat_words(words[:3]) == quality.repeat_words([]) == 0


# --- Secrets

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_secrets_equal_brute_force(spark, sf_dir, messy, which):
    docs = table(spark, sf_dir, "documents") if which == "documents" else messy
    want = []
    for r in docs.collect():
        base = plain_base(r.text or "")
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        want.append((r.doc_id, *(sum(k == x for _, k, _ in base) for x in range(3)), sha(shown.encode()), shown))
    rows = secrets.secret_scans(docs).collect()
    got = [(*r[:5], ",".join(s for s in r.spans.split(",") if not s.startswith("novel"))) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "toKEN", "api", "_", "key", "=", ": ", " ", '"', "abcdefgh", "12345678", "AKIA", "ABCDEFGHIJKL", "deadbeef", "é", "K", "ſecret", "\n"]), max_size=25))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == plain_base(text)


def test_novel_spans():
    novel = "bearer Zk9+Qw3ErT8yUi2OpLkJ7hGfXc5VbN1m was sent"
    assert [x for x in secrets.scan(novel)[4].split(",")] == ["novel:7:39"]
    for text in (
        "bearer 1111111111111111111111111111 was sent",  # shrinks
        "some words Zk9+Qw3ErT8yUi2OpLkJ7hGfXc5VbN1m here",  # no sensitive context
        "token of anstheentianthonwhereblen here",  # no digit
        "access_key abcdefghijklmnopqrstuvwxyz0123456789 here",  # in the primer
    ):
        assert secrets.scan(text)[4] == ""


KEY = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzQ8vT2uA5s"


@pytest.mark.parametrize(
    "name", ["export AWS_SECRET_ACCESS_KEY=", "PRIVATE_KEY=", "db_pwd=", "pwd=", "https://a.b/c?auth=", "?x=1&access_key=", "auth: x="]
)
@pytest.mark.parametrize("tail", ["", " and more", "&next=1", "\nLOG_LEVEL=debug"])
def test_values_of_unquoted_assignments(name, tail):
    for value in (KEY, KEY[:-1] + "=", KEY[:-2] + "=="):
        text = name + value + tail
        assert secrets.scan(text)[4:] == (f"novel:{len(name)}:{len(name) + len(value)}", 1)
        assert secrets.redact(text) == f"{name}[REDACTED]{tail}"


LOWER = "abcdefghijklmnopqrstuvwxyz"
PLACES = [
    ("token of ", " here"),
    ("It starts, and the old one stops working. Every user of the account has a name and a role. His token ", " is gone."),
    ("export NODE_ENV=production\nDATABASE_HOST=localhost\nDB_PWD=", "\nLOG_LEVEL=debug\nREGION=eu-west-1\n"),
]


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("signs", ["0123456789abcdef", LOWER, LOWER.upper(), LOWER + LOWER.upper(), LOWER + LOWER.upper() + "0123456789"])
def test_random_runs_are_found(signs, place):
    rnd = random.Random(11)
    before, after = place
    for n in (16, 20, 24, 31):
        runs = ["".join(rnd.choice(signs) for _ in range(n)) for _ in range(200)]
        found = sum(secrets.scan(before + x + after)[5] for x in runs)
        assert found >= 198, (n, found)


@pytest.mark.parametrize("place", PLACES)
def test_passphrases_are_found_and_identifiers_are_not(place):
    before, after = place
    for x in ("correcthorsebatterystaple", "purplemonkeydishwasher", "quickbrownfoxjumps", "TrombonePickleVolcano"):
        assert secrets.scan(before + x + after)[5] == 1, x
    for x in ("AWS_SECRET_ACCESS_KEY", "PasswordAuthenticationProvider", "authorization_endpoint", "client_credentials_grant"):
        assert secrets.scan(before + x + after)[5] == 0, x


def test_redaction(messy):
    text = 'a password = "abcdefgh12" b ' + "0123456789abcdef" * 2 + " c"
    assert secrets.redact(text) == 'a [REDACTED]" b [REDACTED] c'
    assert secrets.redact("token=" + "0123456789abcdef" * 2 + "G.") == "[REDACTED]"
    clean = {r.doc_id: r.x for r in messy.select("doc_id", secrets.redacted(messy.text).alias("x")).collect()}
    assert clean[1] is None and clean[2] == "" and "AKIA" not in clean[10]


def test_secrets_empty_table(no_documents):
    assert secrets.secret_scans(no_documents).count() == 0
