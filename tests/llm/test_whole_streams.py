"""Declared articles pass through the host's suffix array token by token, as evidence and for themselves."""

import random

import numpy as np

from exhume.llm import html_extraction as H


def page(*inner: str) -> str:
    return "<html><body><nav>Home</nav><article>" + "".join(f"<p>{x}</p>" for x in inner) + "</article></body></html>"


def test_articles_are_part_of_the_array(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two = "We use small files on this site , accept them", "Write to the editor of this paper at any time"
    rows, want = [], {}

    def add(host, html, kept):
        want[len(rows)] = "\n".join(kept)
        rows.append((len(rows), f"http://{host}/{len(rows)}", html))

    for i in range(8):  # two notices, in one block on a few pages: the block is on no more than those, its tokens are on all
        a, b = prose(30), prose(20)
        add("mixed", page(a, one, two, b) if i < 5 else page(a, f"{one} {two}", b), [a, b])
    lone = prose(25)
    for _ in range(12):  # copies of a page without notices don't hide them in any part of the pages
        add("mixed", page(lone), [lone])
    for _ in range(4):
        a = prose(30)
        add("open", page(a, one), [a])
    a = prose(30)  # what articles repeat is known on a page that declares none
    add("open", f"<html><body><nav>Home</nav><div><p>{a}</p><p>{one}</p></div></body></html>", [a])
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in H.extract(frame).collect()} == want


def test_a_common_suffix_is_a_candidate_in_some_part():
    rng = random.Random(3)
    for _ in range(200):
        pages = {th: set(rng.choices(range(12), k=5)) for th in range(rng.randrange(3, 12))}
        shown = [th for th in pages for _ in range(rng.choice([1, 1, 1, 4]))]
        rng.shuffle(shown)
        least = np.full(H.NUMBERS, len(pages) / (2 * len(shown)))
        found = set()
        for at in range(0, len(shown), 4):
            part = [("h", th, np.array(sorted(pages[th]))) for th in shown[at : at + 4]]
            found |= {n for _, names in H._candidates(part, least) for n in names.tolist()}
        assert {n for n in range(12) if 2 * sum(n in p for p in pages.values()) > len(pages)} <= found


def test_blocks_whose_tokens_are_all_covered():
    # two blocks of 7 and 2 tokens, each with a border behind it
    assert H._covered(np.array([0, 1]), [7, 2]) == [0]
    assert H._covered(np.array([0]), [7, 2]) == []
    assert H._covered(np.array([0, 1, 4]), [7, 2]) == [0, 1]
    assert H._covered(np.zeros(0, np.int64), [7, 2]) == []
