"""Wrappers whose class speaks of chrome, and text in elements that are not scripts or forms."""

import pytest

from tidemark.llm.htmltext import main_text

STORY = "".join(f"<p>Paragraph {i} tells, at some length, what happened on that day, and why it did.</p>" for i in range(6))
TEXT = " ".join(f"Paragraph {i} tells, at some length, what happened on that day, and why it did." for i in range(6))
SIDE = "<div class='sidebar'><p>Other stories, told elsewhere on this site.</p></div><nav><a>Home</a></nav>"


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='content-with-sidebar'", "div class='page-with-banner'", "div id='search-results'", "section class='widget'", "form id='aspnetForm'"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_a_marked_wrapper_keeps_its_article(wrapper, inner):
    page = f"<html><body><{wrapper}><{inner}>{STORY}</{inner}>{SIDE}</{wrapper.split()[0]}></body></html>"
    assert main_text(page) == TEXT


def test_marks_inside_still_count():
    assert main_text(f"<div class='has-sidebar'><article>{STORY}<div class='ad'>Buy now, cheap.</div></article><div class='related'><article><p>Teaser, short.</p></article></div></div>") == TEXT
    assert main_text(f"<article>{STORY}</article><div class='comments'><article><p>{'I think so too, really, yes. ' * 40}</p></article></div>") == TEXT


def test_only_scripts_styles_templates_and_form_parts_are_dropped():
    got = main_text(f"<article>{STORY}<p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></math> holds, as <svg><path d='M0'/><text>drawn</text></svg> shows.</p><object><p>A table of all figures, in words.</p></object>"
                    "<noscript><p>The picture shows a house, seen from the road.</p></noscript><script>no()</script><style>p{}</style><template><p>No, never.</p></template><select><option>No</select></article>")
    assert got == TEXT + " Here x=1 holds, as drawn shows. A table of all figures, in words. The picture shows a house, seen from the road."
    assert main_text(f"<noscript>Please switch scripts on, thanks.</noscript><article>{STORY}</article>") == TEXT
