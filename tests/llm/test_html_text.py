import pytest

from trustlake.llm.html_text import extract, extract_text


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        (None, ""),
        ("a < b &amp; c&nbsp;d", "a < b & c\xa0d"),
        ("<p>one\n two<p>three", "one two\n\nthree"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<h1>H</h1>text", "H\n\ntext"),
        ("a<b>b</b> <i>c</i>d", "ab cd"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
        ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
        ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
        ("<table><tr><th>n<th>m<tr><td colspan=2>wide<tr><td>1<td>2</table>", "n | m\nwide\n1 | 2"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n    c"),
        ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"),
        ("<table><tr><td><table><tr><td>x<td>y</table><td>z</table>", "x | y | z"),
        ("<head><title>t</title><style>s</style></head>body", "body"),
        ("<script>if (a < b) '</p>'</script>after", "after"),
        ("<p hidden>no</p>yes", "yes"),
        ("<div style='Display : none'>no<p>no</div>yes", "yes"),
        ("<span style='visibility:hidden'>no</span>yes", "yes"),
        ("a<!-- no --><!doctype x><?php no ?>b", "ab"),
        ('<a title="x>y">l</a>', "l"),
        ("text <div class='open", "text"),
        ("<title>only", ""),
        ("</p>x</div></b>y", "xy"),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


def test_table_rows_are_aligned():
    rows = [("name", "qty"), ("apple pie", "1"), ("fig", "22")]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    lines = extract(page + "</table>").split("\n")
    assert {line.index("|") for line in lines} == {10}


def test_all_visible_words_and_no_others(rows):
    """Against a plain removal of markup."""
    import html
    import re

    for (page,) in rows("select html from pages"):
        plain = re.sub(r"(?is)<head.*?</head>|<(script|style)\b.*?</\1>|<!--.*?-->", " ", page)
        words = html.unescape(re.sub(r"<[^>]*>", " ", plain)).split()
        got = [w for w in extract(page).split() if w not in ("-", "|")]
        assert got == [w for w in words if w not in ("-", "|")]


def test_hostile_pages():
    for page in ("<div>" * 20_000, '<a "' * 20_000, "<table><tr><td>" * 3_000 + "x", "<ul><li>" * 2_000,
                 "<b>" * 20_000 + "<p>x" * 500, "<" * 50_000, "&" * 50_000, "<!--" * 10_000):
        extract(page)


def test_edges(spark):
    schema = "page_id long, html string, text string, url string"
    pages = [(1, None, "t", None), (None, "<p>a", "t", None), (2, "<p>a", "t", "u"), (2, "<p>a", "t", "u"),
             (3, "<p>word " * 50_000, None, None)]
    df = spark.createDataFrame(pages, schema)
    got = sorted((r.page_id or 0, r.text[:1]) for r in extract_text(df).collect())
    assert got == [(0, "a"), (1, ""), (2, "a"), (2, "a"), (3, "w")]
    assert extract_text(df.where("false")).collect() == []
