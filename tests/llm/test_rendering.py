import random

import pytest

from chatlake.llm.rendering import events, extract, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>z", "* a\n* b\n  3. x\n  4. y\n* c\n\nz"),
        ("<table><tr><td>a<td>bbb<tr><th>cccc</th><td>d</table>", "a     bbb\ncccc  d"),
        ("<table><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
        ("x<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>y", "x\n\nin  ner  out\n\ny"),
        ("<td>loose</td> <li>item", "loose\n* item"),
        ("<head><title>no</title></head><script>if (a<b) '</p>'</script><style>p{}</style>yes<!-- no --><template>no</template>", "yes"),
        ("a<div hidden>no<p>no</div><span style='display:NONE'>no</span><input type=hidden>b", "ab"),
        ("<pre>a\n  b</pre>&lt;&eacute;&#33;", "a\n  b\n\n<é!"),
        ("<blockquote>q</blockquote>t", "    q\n\nt"),
        ("<b>bold <i>both</b> rest</i>", "bold both rest"),
        ("a < b and <3 &amp; 'x\" <a href=\"y>z\">link</a", "a < b and <3 & 'x\" link"),
        ("open <!-- comment", "open"),
        ("<textarea>a <b></textarea>", "a <b>"),
    ],
)
def test_layout(page, text):
    assert render(page) == text


def test_any_tags_nest_and_render():
    rng = random.Random(3)
    tags = "p div b table tr td th ul ol li blockquote pre br dd dl dt select option script body html head caption tbody span".split()
    for _ in range(3000):
        page = "".join(
            rng.choice(("<%s>", "</%s>", "<%s hidden>")) % rng.choice(tags) if rng.random() < 0.7 else rng.choice(["x y", "&amp;", "<", '"', "<!--", "\n"])
            for _ in range(rng.randrange(30))
        )
        stack = []
        for kind, name, _ in events(page):
            if kind == "start":
                stack.append(name)
            elif kind == "end":
                assert stack.pop() == name
        assert not stack
        render(page)


def test_depth_and_length_are_no_limit():
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<p>x" * 50_000).count("x") == 50_000


def test_rows(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (2, None, "t"), (None, "", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", "a"), ("1", "a"), ("2", ""), ("None", "")]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
