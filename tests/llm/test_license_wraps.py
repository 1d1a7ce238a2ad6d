"""Notices count wherever their lines break."""

import textwrap

import brute
import pytest
from siltlake.llm import licenses

LONG = [(label, t) for label, t, _ in licenses.TEMPLATES if len(set(t.split())) >= licenses.WHOLE]


@pytest.mark.parametrize("width", [30, 70])
def test_wrapped_notices(docs_of, width):
    around = "some words of the text that stand before a notice and after it\n"
    rows = [(k, around + textwrap.fill(t, width) + "\n" + around) for k, (_, t) in enumerate(LONG)] * 3
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in licenses.scan(docs_of(rows)).collect()}
    for k, (label, _) in enumerate(LONG):
        assert label in got[k][0] and got[k][1] == 1.0


def test_scattered_words_are_no_notice(docs_of):
    apart = ("\n" + "filler " * 12 + "\n").join(dict(LONG)["bsd"].split())
    assert [(r["labels"], r["score"]) for r in licenses.scan(docs_of([(1, apart)])).collect()] == [("", 0.0)]


def test_what_tells_licenses_apart(docs_of):
    texts = {t: label for label, t, _ in licenses.TEMPLATES} | {"Released under the BSD License.": "", "Licensed under CC BY 4.0.": "cc-by", "some words " * 400 + "hereby granted": ""}
    texts["licensed under the GNU General Public License, version 2."] = "gpl"
    texts[" ".join(x for w in LONG[1][1].split() for x in (w, "so", "it", "goes"))] = ""
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs_of(list(enumerate(texts)))).collect()}
    for k, (t, label) in enumerate(texts.items()):
        base = brute.license_base(t, licenses.PHRASES)[-1]
        assert got[k] == ",".join(sorted({x for x in (base, label) if x})), t
