"""Pages that text density alone gets wrong, hostile pages, and the sums against a plain definition."""

import random
import time

import pytest

from wavequery.llm import html_text

REMARK = "<p>I do not agree with any of this at all, and neither does anyone I have ever met.</p>"
PARAGRAPH = "<p>The one paragraph of the article, with a good many plain words in it to read.</p>"
MENU = "<nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize("names", ['class="comments"', 'id="disqus_thread"', 'class="userResponses"', 'class="post-replies"'])
def test_comments_never_displace_an_article(names):
    comments = f"<section {names}>{REMARK * 40}</section>"
    for article in (f"<article>{PARAGRAPH}</article>", f"<div>{PARAGRAPH}{PARAGRAPH}</div>", f"<main><div>{PARAGRAPH}</div></main>"):
        for page in (f"<body>{MENU}{article}{comments}</body>", f"<body>{comments}{article}</body>", f"<body><form>{article}{comments}</form></body>"):
            got = html_text.extract(page)
            assert "agree" not in got and got.count("paragraph of the article") == article.count("<p>")
    inner = f"<article>{PARAGRAPH}{comments}</article>"
    assert "agree" not in html_text.extract(f"<body>{inner}</body>")


def test_articles_of_readers_and_teasers_are_no_text():
    teasers = "".join(f"<article><p>Teaser {i}: something else that one could read instead of this.</p></article>" for i in range(3))
    answers = f'<div class="responses"><article>{REMARK}</article><article>{REMARK}</article></div>'
    got = html_text.extract(f"<body><main><article>{PARAGRAPH * 3}</article></main><div>{teasers}</div>{answers}</body>")
    assert got.count("paragraph of the article") == 3 and "Teaser" not in got and "agree" not in got


def test_short_articles_take_no_footers():
    page = f"<body><article>{PARAGRAPH}</article><div>© 2024 The paper</div><div>Call us at 555 0100</div></body>"
    assert html_text.extract(page) == "The one paragraph of the article, with a good many plain words in it to read."


def test_camel_case_names_and_short_source_lists():
    sources = "<ul><li><a href=/a>First source</a></li><li><a href=/b>Second source</a></li></ul>"
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Elsewhere {i}</a></li>" for i in range(12)) + "</ul>"
    page = f'<article>{PARAGRAPH * 4}<div class="adBox">Buy this now</div>{sources}{PARAGRAPH}{menu}</article>'
    got = html_text.extract(f"<body>{page}</body>")
    assert "Buy" not in got and "First source\n\nSecond source" in got and "Elsewhere" not in got
    assert got.count("paragraph of the article") == 5
    assert html_text.extract(f'<body><div class="headAdmin">{PARAGRAPH * 3}</div></body>').count("paragraph") == 3


UNITS = [
    "<a ", "<div>", "<a x=\"1\"", "<a \">\" ", "<", "<a", "</a", "<!--", "<!", "<b>", "<b><p>", "</p>", "<p></b>", "<a x='\">", "<script>",
    "<li>", '<div class="ad">x</div>', "<article>", '<p class="', "<td><tr>", "&amp", "<i></p>",
]


@pytest.mark.parametrize("unit", UNITS)
def test_hostile_pages_take_linear_time(unit):
    page = f"<body><article>{PARAGRAPH * 3}" + unit * (1_000_000 // len(unit))
    begin = time.perf_counter()
    html_text.extract(page)
    small = time.perf_counter() - begin
    # 1 MB in a few seconds on a busy machine; quadratic work would take hours.
    assert small < 15


def made(rnd, depth=0):
    """A random page fragment without set-aside elements."""
    if depth == 4 or rnd.random() < 0.3:
        return " ".join("word" * rnd.randrange(1, 4) for _ in range(rnd.randrange(6)))
    tag = rnd.choice(["div", "section", "ul", "a", "article"])
    return f"<{tag}>" + "".join(made(rnd, depth + 1) for _ in range(rnd.randrange(4))) + f"</{tag}>"


def plain(block):
    """Characters, tags, linked characters and links of a block, by their definition."""
    chars = tags = linked = links = 0
    for part in block.parts:
        if isinstance(part, str):
            chars += len("".join(part.split()))
        else:
            c, t, lc, n = plain(part)
            chars, tags, linked, links = chars + c, tags + t + 1, linked + lc, links + n
    return (chars, tags, chars, links + 1) if block.tag == "a" else (chars, tags, linked, links)


@pytest.mark.parametrize("seed", range(30))
def test_weights_equal_their_definition(seed):
    blocks = html_text.tree(f"<body>{made(random.Random(seed))}{made(random.Random(seed + 99))}</body>")
    html_text.weigh(blocks)
    whole = plain(blocks[0])
    for block in blocks:
        found = plain(block)
        assert (block.chars, block.tags, block.linked, block.links) == found
        assert block.density == html_text._density(*found, whole[2] / max(whole[0], 1))
        assert block.sum == pytest.approx(sum(html_text._density(*plain(c), whole[2] / max(whole[0], 1)) for c in block.children))
    subtree = [b for b in blocks if b.sum > 0]
    assert not subtree or blocks[0].peak.sum == pytest.approx(max(b.sum for b in subtree))
