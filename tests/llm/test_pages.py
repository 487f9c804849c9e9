import random
import time

from caseloom.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies, and you agree.</div><!-- <p>hidden</p> -->
<article><header><h1>The title</h1></header><p><b>First  paragraph&nbsp;with &amp; sign,
and more text that goes on.<br>After a break.<p>Second: 1 &lt; 2, <i>yes</i>.</p><ul><li>One item, here<li>Another item, there.</ul>
<div class="ad">Buy this now, it is great, really great, so great.</div>
<blockquote>Short quote.</blockquote></article>
<aside><p>Read also this long text, with punctuation, and so on, and on.</p></aside>
<form><p>Your mail, please.</p><input name=q></form>
<section id="comments"><p>A reader says, at length, that this is nonsense, and so on.</p></section>
<footer>&copy; 2024 Example, all rights reserved.</footer></body></html>"""

TEXT = "The title\n\nFirst paragraph with & sign, and more text that goes on. After a break.\n\nSecond: 1 < 2, yes.\n\nOne item, here\n\nAnother item, there.\n\nShort quote."


def test_article_without_the_rest():
    assert pages.main_text(PAGE) == TEXT


def test_ratios_choose_among_plain_divisions():
    body = "".join(f"<div class=story><p>Sentence number {i}, which is long enough, has commas, and ends.</p></div>" for i in range(9))
    links = "".join(f"<div class=row><span>word{i}</span></div>" for i in range(30))
    got = pages.main_text(f"<html><body><div class=left>{links}</div><div class=middle>{body}</div></body></html>")
    assert "Sentence number 8" in got and "word3" not in got


def test_odd_pages():
    assert pages.main_text("") == "" and pages.main_text("<html><body></body></html>") == ""
    assert pages.main_text("just text, a < b & c &eacute;") == "just text, a < b & c é"
    assert pages.main_text("<p>open <!-- never closed <p>x") == "open"
    assert pages.main_text("<p>a</p><script>never closed") == "a"
    assert pages.main_text("<p>a <b title='x>y'>b</b> c<p") == "a b c"
    assert pages.main_text("<table><tr><td>one, two<td>three, four</table>") == "one, two\n\nthree, four"


def test_long_and_broken_pages_take_linear_time():
    for piece in ("<p>word, ", "<div>", "<b>", "<!--", '<a "', "<script>", "</p>", "<li><p>x,", "&", "<"):
        began = time.time()
        pages.main_text(piece * 40_000)
        assert time.time() - began < 8, piece


def test_random_tags_never_fail():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='ad x'>", "</div>", "<article>", "</article>", "text, ", "&amp;", "<li>", "<br/>", "<table><td>", "</table>", "<h1>", "</h1>", "<", ">", '"', "<nav>", "</nav>", "é ", "<svg/>", "<script>", "</script >"]
    for _ in range(500):
        text = pages.main_text("".join(rng.choice(bits) for _ in range(60)))
        assert "\n\n\n" not in text and text == text.strip() and "<p>" not in text


def test_contract(spark, tmp_path):
    from caseloom.llm.queries import op1_tag_paths

    rows = [(1, "u1", PAGE, "a"), (2, None, None, "b"), (3, "u3", "", "c"), (1, "u1", PAGE, "a")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in op1_tag_paths(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, "u1", TEXT, len(TEXT)), (1, "u1", TEXT, len(TEXT)), (2, None, "", 0), (3, "u3", "", 0)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_short_items_of_an_article_stay():
    story = "".join(f"<p>Paragraph {i}, {'long words ' * 17}, and so on, to its end.</p>" for i in range(5))
    for n in (5, 10, 30):
        ul = "<ul>" + "".join(f"<li>item{i:02}</li>" for i in range(n)) + "</ul>"
        table = "<table><tr>" + "".join(f"<td>cell{i:02}</td>" for i in range(n)) + "</tr></table>"
        for hold in ("article", "div"):
            got = pages.main_text(f"<html><body><{hold}>{story}{ul}{table}</{hold}></body></html>")
            assert all(f"item{i:02}" in got and f"cell{i:02}" in got for i in range(n))


def test_many_open_elements_and_paths_lose_nothing():
    story = "".join(f"<p>Paragraph {i}, long enough, with commas, and an end.</p>" for i in range(3))
    for end in ("nav", "div class=menu"):
        got = pages.main_text(f"<body><{end}>{'<font>x' * 300}</{end.split()[0]}><article>{story}</article></body>")
        assert "Paragraph 0" in got and "Paragraph 2" in got and "xx" not in got
    many = "".join(f"<div id=k{chr(97 + i % 26)}{chr(97 + i // 26)}>short{i}</div>" for i in range(500))
    paths, found = pages.blocks(f"<body><div>{many}</div></body>")
    kept = pages.content_paths(paths, found)
    assert len({path in kept for path, *_ in found}) == 1
    deep, found = pages.blocks("<div>" * 70 + "a<div>b")
    assert len({path for path, *_ in found}) == 2


STORY = "".join(f"<p>Paragraph {i} of the story, which is long enough, has commas, and comes to an end.</p>" for i in range(6))


def test_ratios_remove_what_no_name_tells():
    page = f"<body><div class=x1><a>Home</a> <a>About</a></div><div class=x2><div class=x3>{STORY}</div></div><div class=x4>Copyright 2024</div><div class=x5><span>One</span> <span>Two</span></div></body>"
    got = pages.main_text(page)
    assert got.count("Paragraph") == 6 and not any(x in got for x in ("Home", "Copyright", "One"))


def test_names_are_a_weak_feature():
    page = f'<body><div class="entry-header"><h1>The title</h1></div><div class="entry-content">{STORY}<div class="related-work"><p>Others have, at length, written on this, and so on, to the end.</p></div></div><div class="related"><p>See also, if you like, this.</p></div></body>'
    got = pages.main_text(page)
    assert got.startswith("The title") and "Others have" in got and "See also" not in got
    only = pages.main_text(f'<body><div class="widget">{STORY}</div></body>')
    assert only.count("Paragraph") == 6


def brute_scores(paths, found):
    """The scores from their definition: all pairs of paths, steps from the root."""
    import math

    def steps(p):
        out = [p]
        while p:
            p = paths.parent[p]
            out.append(p)
        return out[::-1]

    held = {}
    for path, content, _, text in found:
        if content:
            held.setdefault(path, []).append(text)
    ratio = {p: (sum(map(len, t)) / len(t), (1 + sum(c in ".,;:!?¡¿…、。，！？；：" for x in t for c in x)) / len(t)) for p, t in held.items()}
    out = {}
    for p in ratio:
        total = [0.0, 0.0, 0.0]
        for q in ratio:
            a, b = steps(p), steps(q)
            same = sum(x == y for x, y in zip(a, b))
            far = max(len(a), len(b)) - same
            if far <= pages.NEAR:
                w = math.exp(-((far / pages.SIGMA) ** 2) / 2)
                total = [total[0] + w, total[1] + w * ratio[q][0], total[2] + w * ratio[q][1]]
        weak = any(paths.weak[x] for x in steps(p)) + (any(paths.article[q] for q in ratio) and not paths.article[p])
        out[p] = pages.WEAK**weak * math.log1p(total[1] / total[0]) * math.log1p(total[2] / total[0])
    return out


def test_scores_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        html = "".join(rng.choice(["<div>", "<div class=a>", "<div class=ad>", "</div>", "</div>", "<p>", "<section>", "</section>", "<article>", "</article>", "word, and more. ", "x ", "<ul><li>"]) for _ in range(rng.randrange(120)))
        paths, found = pages.blocks(html)
        got, want = pages.scores(paths, found), brute_scores(paths, found)
        assert got.keys() == want.keys() and all(abs(got[p][0] - want[p]) < 1e-6 * max(1.0, want[p]) for p in want)


def test_the_ratio_step_removes_blocks_of_the_test_pages():
    import pyarrow.parquet as pq

    gone = shown = 0
    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        paths, found = pages.blocks(html or "")
        kept = pages.content_paths(paths, found)
        gone += sum(content and path not in kept for path, content, *_ in found)
        shown += sum(content and path in kept for path, content, *_ in found)
    assert gone > 0 and shown > 4 * gone


def test_very_deep_and_very_long_pages():
    deep = "<div>" * 3000 + STORY + "</div>" * 3000
    assert pages.main_text(f"<body>{deep}</body>").count("Paragraph") == 6
    began = time.time()
    long = "".join(f"<div class=k{i}><p>Paragraph {i}, long enough, with commas, and an end.</p></div>" for i in range(20_000))
    assert pages.main_text(f"<body><main>{long}</main></body>").count("Paragraph") == 20_000 and time.time() - began < 20
