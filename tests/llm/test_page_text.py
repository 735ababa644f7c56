"""op10: layout on hand fixtures, and the visible words against an independent reader."""

import random
from html.parser import HTMLParser

from graphloom.llm import page_text
from graphloom.llm.page_text import render


class Plain(HTMLParser):
    """All text outside script, style, title and template elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title", "template")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title", "template")
        self.found.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.found.append(data)


def test_blocks_and_inline():
    assert render("<p>One <b>two</b>\n three<p>four<br>five</p><div>six</div>seven") == "One two three\n\nfour\nfive\n\nsix\nseven"
    assert render("a<span> b</span><i>c</i> d&amp;e &copy; &nbsp;x") == "a bc d&e ©  x"
    assert render("<h1>T</h1><section>s</section><hr>t") == "T\n\ns\n\n---\n\nt"


def test_lists():
    assert render("<ul><li>a<li>b<ol start=3><li>c<li value=7>d</ol><li>e</ul>") == "• a\n• b\n  3. c\n  7. d\n• e"
    assert render("<dl><dt>k<dd>v<dt>k2<dd>v2</dl>") == "k\n    v\nk2\n    v2"
    assert render("<blockquote>q<p>r</blockquote>s") == "    q\n\n    r\n\ns"


def test_tables():
    assert render("<table><tr><th>Name<th>n<tr><td>a long one<td>1<tr><td>b<td>22</table>") == "Name        n\na long one  1\nb           22"
    assert render("<table><caption>C</caption><tbody><tr><td rowspan=2>x<td>1</tr><tr><td>2</table>end") == "C\nx  1\n   2\n\nend"
    assert render("<table><td>日本<td>b<tr><td>c<td>d</table>") == "日本  b\nc     d"
    assert render("<table><tr><td>a<p>b<td>c</table>") == "a  c\n\nb"
    assert "in" in render("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>")


def test_pre_keeps_spaces():
    assert render("<pre>\na  b\n\n  c</pre>d") == "a  b\n\n  c\n\nd"
    assert render("<textarea>\n x &lt;</textarea>") == " x <"


def test_visibility():
    page = """<head><title>t</title><style>.ad, #x {display:none} p.q{visibility:hidden} /* b{display:none} */</style></head><body>
    <div class="ad big">no</div><div id=x>no</div><p class=q>no<i style="visibility: visible">yes</i></p><b>bold</b>
    <div hidden>no</div><span style="DISPLAY:none">no</span><template>no</template><script>no</script><!-- no -->
    <details><summary>sum</summary>no</details><details open><summary>s2</summary>shown</details><dialog>no</dialog><input type=hidden value=no>
    <select><option>o1<option selected>o2</select>"""
    words = render(page).split()
    assert words == ["yes", "bold", "sum", "s2", "shown", "o2"]


def test_broken_pages():
    assert render("a<b") == "a"
    assert render("a < b <3 </p>") == "a < b <3"
    assert render('a<p title="x>y">b') == "a\n\nb"
    assert render('a<p title="never closed>b') == "a"
    assert render("a<!-- open") == "a"
    assert render("<script>var a='</p>';") == ""
    assert render("</div></li>x</table>y") == "xy"
    assert render("<div>" * 50_000 + "deep") == "deep"
    assert render("<table><tr><td>" * 400 + "x").strip() == "x"
    assert render("<b><p>x</b>y<p>z") == "xy\n\nz"
    assert len(render("<" * 200_000)) == 200_000


def test_stray_quotes_in_tags():
    assert render("<td title=Bob's>hello</td><p>rest of page</p>") == "hello\n\nrest of page"
    assert render('<p class=x">a</p> text <a href="u">b</a>') == "a\n\ntext b"
    assert render("<i title=Bob's>a</i> b <i title=Ann's>c</i>") == "a b c"
    assert render('<p "x>a</p><i x"y=1>b</i><i =">c</i><i a=>d</i><i b="x>y"c=\'>\'>e') == "a\n\nbcde"
    assert page_text.Node("a", " href=/x/ title=Bob's  k = 'v w' hidden").attributes == {"href": "/x/", "title": "Bob's", "k": "v w", "hidden": ""}
    assert render('<i style=display:none;x:" a">no</i>yes') == "yes"
    assert render("a<p title='never closed>b") == "a"
    assert len(render("<b a=' " * 50_000)) == 0


def test_style_sheets():
    assert render("<style>@media print{.x{display:none}}</style><p class=x>seen") == "seen"
    assert render("<style>#a{display:block} p{display:none}</style><p id=a>seen<p>no") == "seen"
    assert render("<style>p{display:none!important} #a{display:block}</style><p id=a style='display:block'>no") == ""
    assert render("<style>p{display:none !important}</style><p style='display:block ! important'>seen") == "seen"
    assert render("<style media=print>p{display:none}</style><style media='screen, print'>i{display:none}</style><p>seen<i>no") == "seen"
    assert render("<style>@import 'a;b'; @font-face{src:x} @media screen and (max-width: 600px){p{display:none}} @media (min-width:40em){b{display:none}}</style><p>seen<b>no") == "seen"
    assert render("<style>@supports (display:grid){@media not print{.a .b > i{display:none}}}</style><p class=a><u class=b><i>no</i><s><i>seen") == "seen"
    assert render("<style>.a .b i{display:none} [k='v w'], [q]{display:none} p:hover{display:none}</style><p class=b><i>seen<u k='v w'>no</u><u k=v>too</u><u q>no") == "seentoo"
    assert render("<style>p{/*}*/display:none} i{content:'}'; display:none} b{display:inline}</style><p>no</p><i>no</i><b hidden>seen") == "seen"
    assert render("<style>p{color:red; .x{display:none} visibility:hidden}</style><p>no<b class=x style=visibility:visible>seen") == "seen"
    assert render("<style>p{display:none</style><p>no</p>seen") == "seen"
    assert len(render("<style>.x div{display:none}</style>" + "<div>" * 20_000 + "deep")) == 4


def test_visibility_against_brute_force():
    """Nested elements under random rules: each element's winning declaration is looked for anew."""
    r = random.Random(3)
    for _ in range(300):
        rules = []
        for _ in range(r.randint(1, 6)):
            screen = r.random() < 0.7
            tag, name, kind = r.choice(["b", "i", "*", ""]), r.choice(["", "", "#u", "#v"]), r.choice(["", ".x", ".y", ".x.y"])
            if tag in ("b", "i") or name + kind:  # a rule for all would hide the page
                rules.append((screen, tag, name, kind, r.choice(["none", "inline"]), r.random() < 0.3))
        sheet = "".join(f"@media {'screen' if s else 'print'}{{{t}{n}{k}{{display:{v}{'!important' if m else ''}}}}}" for s, t, n, k, v, m in rules)
        page, wanted, stack = f"<style>{sheet}</style>", [], [True]
        for k in range(12):
            if len(stack) > 1 and r.random() < 0.4:
                page += f"</{tags.pop()}>"
                stack.pop()
            if len(stack) == 1:
                tags = []
            tag, name, kinds = r.choice("bi"), r.choice(["", "u", "v", "w"]), r.choice(["", "x", "y", "x y"])
            inline = r.choice([None, None, None, ("none", False), ("inline", True)])
            best = (False,)
            shown = "inline"
            for order, (screen, t, n, c, value, important) in enumerate(rules):
                if screen and t in ("", "*", tag) and n in ("", "#" + name) and set(c.split(".")[1:]) <= set(kinds.split()):
                    key = (True, important, False, bool(n), c.count("."), t not in ("", "*"), order)
                    if key > best:
                        best, shown = key, value
            if inline and (True, inline[1], True) > best[:3]:
                shown = inline[0]
            style = f' style="display:{inline[0]}{"!important" * inline[1]}"' if inline else ""
            page += f'<{tag} id="{name}" class="{kinds}"{style}> w{k} '
            tags.append(tag)
            stack.append(stack[-1] and shown != "none")
            if stack[-1]:
                wanted.append(f"w{k}")
        assert render(page).split() == wanted, page


def test_spans_as_html_allows_them():
    tall = "<table><tr><td rowspan=3000>x<td>0" + "".join(f"<tr><td>{k}" for k in range(1, 3000)) + "</table>"
    assert render(tall).split("\n")[2999] == "   2999"
    assert render("<table><tr><td rowspan=0>x<td>0<tr><td>1<tbody><tr><td>y</table>") == "x  0\n   1\ny"
    assert render("<table><tr><td colspan=' 2x'>wide<tr><td>a<td>b</table>") == "wide\na  b"
    assert render(f"<table><tr><td rowspan={'9' * 5000} colspan=-1>x<td>0<tr><td>1</table>") == "x  0\n   1"
    assert len(render("<table>" + "<tr>" + "<td colspan=1000 rowspan=65534>x" * 3000 + "<tr><td>y" * 30 + "</table>").split()) == 3030


def test_tables_within_tables_at_any_depth():
    deep = "<table><tr><td>k<td>" * 3000 + "in" + "</table>" * 3000
    assert render(deep).split() == ["k"] * 3000 + ["in"]
    page = "<table><tr><td>a<td>b<tr><td>long<td>c</table>"
    for _ in range(12):
        page = f"<table><tr><td>{page}</table>"
    assert render(page) == "a     b\nlong  c"


def test_graphics_formulas_and_maps():
    assert render("<svg><title>no</title><defs><text>no</text></defs>no<g><text>two <tspan>words</tspan></text><text>more</text></g></svg>end") == "two words moreend"
    assert render("x<math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>no</annotation></math><map name=m>shown<area alt=no></map>") == "xa+bshown"
    assert render("<svg><g style=display:none><text>no</text></g><foreignObject><p>yes</foreignObject></svg>") == "yes"


def test_words_against_plain_reader():
    r = random.Random(8)
    inline, block = ["b", "i", "span", "a", "em"], ["div", "p", "section", "ul", "blockquote", "article", "h2"]

    def piece(depth):
        n = r.random()
        if depth > 5 or n < 0.4:
            return " " + " ".join(r.choice(["alpha", "b&amp;c", "é", "x&lt;y", "1"]) for _ in range(r.randint(1, 5))) + " "
        if n < 0.5:
            return "<script>var x = '<p>no</p>';</script><!-- <b>no</b> -->"
        if n < 0.6:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{piece(depth + 2)}" for _ in range(3)) for _ in range(2)) + "</table>"
        tag = r.choice(inline + block)
        body = "".join(piece(depth + 1) for _ in range(r.randint(0, 4)))
        return f"<{tag}>{'<li>' * (tag == 'ul')}{body}</{tag}>"

    for _ in range(200):
        page = "<html><head><title>no</title></head><body>" + "".join(piece(0) for _ in range(6))
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert sorted(w for w in render(page).split() if w != "•") == sorted("".join(plain.found).split())


def test_rows(spark):
    rows = [(1, "u", "<p>a", "t"), (None, None, None, "t"), (2, "v", "", None), (1, "u", "<p>a", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, page_text.extract(pages).collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert page_text.extract(pages.limit(0)).count() == 0
