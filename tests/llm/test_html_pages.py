"""Pages that lost their article or took hours."""

from __future__ import annotations

import time

import pytest

from leaksieve.llm.html_text import Page

BODY = "<p>" + "A sentence of the article that says something. " * 12 + "</p>"


def texts(source: str) -> list[str]:
    return [text for _, text in Page(source).blocks]


@pytest.mark.parametrize(
    "before",
    [
        '<svg class="i"/>', '<svg class="i" />', "<math/>", "<svg><svg><path/></svg>no</svg>", "<svg><svg/>no</svg>",
        "<svg>no<text>no</text></svg>", "<SVG>no</sVg>", "<script>if (a < b) '</p>'</script>", "<svg><!-- --></svg >",
    ],
)
def test_drawings_swallow_no_article(before):
    got = texts(f"<body>{before}<article>{BODY}</article></body>")
    assert len(got) == 1 and got[0].startswith("A sentence") and "no" not in got[0].split()


@pytest.mark.parametrize(
    "source",
    ["<b>" * 100_000, "<b><p>x</p>" * 30_000, "<b><i></b>" * 50_000, "</i>" * 100_000, "<i>" + "<b></i>" * 50_000,
     "<div>" * 50_000, "<svg>" * 50_000, "<li><b>x" * 30_000, "<p><b>x" * 30_000],
)
def test_unclosed_tags_take_time_in_proportion(source):
    started = time.perf_counter()
    Page(source + BODY)
    assert time.perf_counter() - started < 10
