"""Tags of untrusted pages: found as by a plain scanner, in time that follows the page's length."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import html_text


def plain_end(page: str, at: int) -> int:
    quote = ""
    for i in range(at, len(page)):
        if quote:
            quote = "" if page[i] == quote else quote
        elif page[i] == ">":
            return i + 1
        elif page[i] in "\"'":
            quote = page[i]
    return -1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<a/ =\"'>!-b", max_size=60))
def test_ends_of_tags(page):
    tags, at = html_text.Tags(page), 0
    while tag := tags.after(at):
        start, end, _, name, _ = tag
        if name:
            assert end == plain_end(page, html_text.NAME.match(page, start).end())
        for skipped in range(at, start):  # what was passed over opens no tag
            m = html_text.NAME.match(page, skipped)
            assert not m or plain_end(page, m.end()) < 0
        assert end > start >= at
        at = end


@pytest.mark.parametrize("page", [
    "<a " * 200_000, "<a " * 200_000 + "\"> x", "<p x=\"' " * 100_000, "<!-- " * 100_000, "<div>" * 20_000 + "</b>" * 100_000,
    "<div>" * 10_000 + "<p>Some words here, yes.</p>" * 10_000,
])
def test_hostile_pages_end(page):
    started = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - started < 20  # minutes to hours if it grew with the square


def test_paths_meet():
    a, b, c = html_text.blocks("<div><section><p>One</p><p>Two</p></section></div><p>Three</p>")
    assert html_text.smoothness(a, b) == 1.6  # siblings
    assert html_text.smoothness(b, c) == pytest.approx(1.6 / 3)  # three elements up, one down
