"""Pages that once came out empty or with comments, the first pass of the block rules against loops, and items in blocks."""

import random
import re
import time

import numpy as np
import pytest

pytest.importorskip("mnemo.llm.queries")

from mnemo.llm import decontaminate, html_text  # noqa: E402

RNG = random.Random(8)
FIRST = "The committee said on Monday that it would look at the plans for the new bridge, and that it had no reason to think that they were wrong in any of the details that were given to it by the engineers of the city."
SECOND = "After the meeting the mayor told us that the work would begin in the spring, if the money can be found, and that there is more than one way to pay for it without a new tax on the people who live by the river."
ARTICLE = f"<article><h1>The bridge</h1><p>{FIRST}</p><p>{SECOND}</p></article>"
PLAIN = f"<div><h1>The bridge</h1><p>{FIRST}</p><p>{SECOND}</p></div>"
WANTED = f"The bridge\n\n{FIRST}\n\n{SECOND}"
NAV = "<nav><a href=/>Home</a> <a href=/x>News</a></nav>"
REMARK = f"<p>{SECOND} I do not agree with that at all.</p>"


# ---- op 5


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div id="content-sidebar"', 'div class="site page-header"', 'div class="ad-free"', 'form id="form1"', 'div role="dialog"', 'header'])
def test_wrappers_are_no_furniture(wrapper):
    tag = wrapper.split()[0]
    for inner in (ARTICLE, PLAIN):
        assert html_text.main_text(f"<body>{NAV}<{wrapper}>{inner}</{tag}><footer>All about us and our work</footer></body>") == WANTED


@pytest.mark.parametrize(
    "comments",
    [
        f"<article class=comment>{REMARK}</article>",
        f"<section id=reader-responses><h2>Comments</h2>{REMARK}</section>",
        f"<section id=x1><h2>12 Comments</h2>{REMARK}{REMARK}</section>",
        f"<div class='disqus-thread'>{REMARK}</div>",
        f"<section><h3>Leave a reply</h3>{REMARK}</section>",
    ],
)
def test_comments_of_readers_go(comments):
    for inner in (ARTICLE, PLAIN):
        assert html_text.main_text(f"<body>{NAV}{inner}{comments}</body>") == WANTED
    within = ARTICLE.replace("</article>", comments + "</article>")
    assert html_text.main_text(f"<body>{within}</body>") == WANTED


def test_related_articles_beside_the_text_do_not_displace_it():
    page = f"<body>{NAV}{PLAIN}<div class=related><article><h3>Another one</h3><p>{FIRST[:90]}</p></article></div></body>"
    assert html_text.main_text(page) == WANTED


@pytest.mark.parametrize(
    "text",
    [
        "昨日、市議会は新しい橋の計画について話し合い、技術者が示した細部に誤りはないと述べた。市長は会議のあとで、資金が見つかれば春に工事を始めると語った。川沿いに住む人々への新しい税はない。",
        "Вчера городской совет обсудил планы строительства нового моста и заявил, что не видит причин сомневаться в деталях, представленных инженерами города. После заседания мэр рассказал, что работы начнутся весной, если найдутся деньги, и что налог не потребуется.",
    ],
)
def test_languages_without_a_list_of_stop_words(text):
    page = f"<body>{NAV}<div><h1>{text[:8]}</h1><p>{text}</p><p>{text[::-1]}.</p></div><div class=footer>{text[:20]}</div></body>"
    assert html_text.main_text(page) == f"{text[:8]}\n\n{text}\n\n{text[::-1]}."


def test_an_open_link_ends_at_the_next_block():
    assert html_text.main_text(f"<body>{NAV}<div><p>{FIRST} <a href=x>more</p><p>{SECOND}</p></div></body>") == f"{FIRST} more\n\n{SECOND}"


@pytest.mark.parametrize("piece", ["<!--", "<div class=nav>", "<a>", "<p class=ad><a href=x>", "<h2>Comments</h2>", "<article>", "<![", "<button>x"])
def test_time_grows_with_the_page(piece):
    def took(n):
        began = time.process_time()
        html_text.main_text(piece * n + "x")
        return time.process_time() - began

    small, large = took(8_000), took(64_000)
    assert large < 2 or large < 20 * small


def test_first_pass_matches_the_rules():
    """A plain reading of the rules, block by block."""
    stop, other = sorted(html_text.STOP_WORDS), ["kamel", "brunto", "silvar", "©", "table"]
    for _ in range(3000):
        text = " ".join(RNG.choice(stop) if RNG.random() < RNG.choice([0.1, 0.25, 0.5]) else RNG.choice(other) for _ in range(RNG.randrange(1, 70)))
        linked, furniture, inside = RNG.choice([0, 0, len(text) // 6, len(text) // 4, len(text)]), RNG.random() < 0.1, RNG.choice([None, True, False])
        words = re.findall(r"[^\W\d_]+", text.lower())
        share = len([w for w in words if w in html_text.STOP_WORDS]) / len(words) if words else 0
        if furniture:
            want = "bad"
        elif inside:
            want = "bad" if linked > 0.8 * len(text) and share < 0.3 else "short" if len(text) < 70 else "good" if share >= 0.3 and len(text) > 200 else "near"
        elif linked > 0.2 * len(text) or ("©" in text and len(text) < 200):
            want = "bad"
        elif len(text) < 70:
            want = "short"
        elif share >= 0.3 and len(text) > 200 and inside is None:
            want = "good"
        else:
            want = "near" if share >= 0.2 else "bad"
        assert html_text.classify(text, linked, furniture, inside) == want


# ---- op 1


def test_one_block_of_items_and_many_give_the_same(spark, monkeypatch):
    words = [f"w{k}" for k in range(4000)]
    preamble = " ".join(RNG.choice(words) for _ in range(12))
    items = [(k, preamble + " " + " ".join(RNG.choice(words) for _ in range(30))) for k in range(60)]
    docs = []
    for k in range(300):
        w = RNG.choice(items)[1].split()
        for _ in range(RNG.randrange(0, 5)):
            w[RNG.randrange(len(w))] = RNG.choice(words)
        docs.append((k, " ".join([RNG.choice(words) for _ in range(20)] + w + [RNG.choice(words) for _ in range(20)])))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1500)
    blocks = len(list(decontaminate.item_blocks(bench)))
    many = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    assert blocks > 5 and len(one) > 50 and one == many


def test_weights_of_shingles_that_many_items_share(spark, monkeypatch):
    """Of a benchmark of many items only what many share is told to all blocks, and the rest weighs as what none has."""
    monkeypatch.setattr(decontaminate, "FREQUENT", 10)
    items = spark.createDataFrame([(k, f"all items say this but number{k} differs here and word{k % 30} too") for k in range(60)], "item_id long, text string")
    weights = decontaminate.item_weights(items)
    assert weights.items == 60 and 0 < len(weights.shingles) < 20
    assert (np.diff(weights.shingles.astype(object)) > 0).all() and (weights.weights < weights.rarest).all()


def test_near_duplicates_take_candidates_by_simhash(spark):
    """Keys of fingerprints within two bits are candidates: those of one fingerprint by its smallest key, and these by links."""
    from mnemo.llm import simhash

    rows = [(1, 5, 0b0), (2, 5, 0b0), (3, 5, 0b11), (4, 5, 0b11 << 40), (5, 0, 0b0), (6, 5, (1 << 62) - 1)]
    got = simhash._simhash_pairs(spark.createDataFrame(rows, "key long, size long, fp long")).collect()
    assert sorted((r.u, r.v) for r in got) == [(2, 1), (3, 1), (4, 1)]
    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words that stand here alone"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3, 4]
