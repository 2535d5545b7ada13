import math
from collections import Counter

import pytest

from tests.oracle import SF_DIR

from sourcelens.llm import licenses as lic

LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
}


def test_query(spark):
    """Documents with a licence line get its licence, all others none."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in lic.op1_licenses(spark, SF_DIR).collect()}
    assert got.keys() == docs.keys()
    n = 0
    for i, t in docs.items():
        lines = (t or "").split("\n")
        want = {v for k, v in LINES.items() if k in lines} | {"Proprietary" for x in lines if "All rights reserved." in x}
        assert (got[i].license in want) if want else got[i].license is None, (i, want, got[i])
        n += bool(want)
    assert n > 5


def brute_cosine(block, template):
    bags = [lic.terms(t) for _, t in lic.TEMPLATES]
    n = len(bags)
    weight = lambda w: math.log((1 + n) / (1 + sum(w in b for b in bags))) + 1
    vec = lambda b: {w: (1 + math.log(k)) * weight(w) for w, k in b.items()}
    a, b = vec(lic.terms(block)), vec(lic.terms(template))
    dot = sum(x * b.get(w, 0) for w, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a else 0.0


def test_cosine_and_anchors():
    own = lic.Templates(lic.TEMPLATES, lic.THRESHOLD)
    for _, text in lic.TEMPLATES:
        for block in (text, text[: len(text) // 2], "foreign words " + text, text.replace("License", "Thing")):
            score, i = own.best(block)
            want = [brute_cosine(block, t) for _, t in lic.TEMPLATES]
            assert abs(score - max(want)) < 1e-9 and abs(want[i] - max(want)) < 1e-9
            words = lic.terms(block)
            if not any(a in words for a in own.anchors):  # the anchors are safe
                assert max(want) < lic.THRESHOLD
        assert own.scan(text)[0] is not None


MIT, APACHE = lic.TEMPLATES[3][1], lic.TEMPLATES[6][1]
FILES = [
    (1, "LICENSE", MIT), (2, "a.py", "print(1)"), (3, "lib/COPYING.txt", "Notice\n\n" + APACHE + "\n"), (4, "lib/x/y/z.c", "int main;"), (5, "lib/x/LICENSE", "nothing known"),
    (6, "lib/q.c", "# Licensed under the Apache License, Version 2.0.\ncode"), (7, "libx/r.c", None), (8, None, "text"), (9, "lib/licence", MIT + " extra"), (9, "lib/licence", MIT + " extra"),
    (None, "lib/x/n", ""), (10, "deep/" * 50 + "f", "w " * 100000),
]


def test_inheritance(spark):
    files = spark.createDataFrame([(*f, 1, "x") for f in FILES], "doc_id long, path string, text string, dir int, license string")
    got = lic.license_scan(files).collect()
    assert len(got) == len(FILES)
    by = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in got}
    assert by[1] == ("MIT", "MIT", None) and by[2] == (None, "MIT", "LICENSE") and by[3][0] == "Apache-2.0"
    assert by[4] == (None, "Apache-2.0", "lib/COPYING.txt") == by[None] == by[5] and by[6] == ("Apache-2.0", "Apache-2.0", None)
    assert by[7] == (None, "MIT", "LICENSE") and by[8] == (None, None, None) and by[9][0] == "MIT" and by[10] == (None, "MIT", "LICENSE")
    assert lic.license_scan(files.limit(0)).count() == 0
    assert Counter(r.doc_id for r in got)[9] == 2


def test_very_long_texts():
    """A notice is found in a text of more than a million characters, and windows find it in a line of thousands of words."""
    own = lic.Templates(lic.TEMPLATES, lic.THRESHOLD)
    notice = next(t for n, t in lic.TEMPLATES if n == "MIT" and len(t) > 300)
    prose = "the quick brown fox of this permission jumps over " * 22000
    assert len(prose) > 10**6 and own.scan(prose)[0] is None
    assert own.scan(notice + " " * 170_000)[:2] == ("MIT", pytest.approx(1))
    assert own.scan(notice + "\n" + prose)[0] == "MIT"
    assert own.scan(prose + "\n" + notice + "\n" + prose)[0] == "MIT"
    filler = " ".join(f"word{i}" for i in range(3000))  # in one line with other words, a window that is mostly notice is needed
    assert own.scan(filler + " " + " ".join([notice] * 5) + " " + filler)[0] == "MIT"


FULL = MIT + (
    ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
GPL = "This work is licensed under the GNU General Public License, version 3."
DOCUMENTS = [
    (1, "Copyright (c) 2024 Jane Doe\n\n" + FULL, "en", "a"), (2, "plain prose of this source", "en", "a"), (3, "prose\n" + GPL, "en", "a"), (4, "andere Worte", "de", "a"), (5, None, "en", "a"),
    (6, GPL, "de", "b"), (7, "Licensed under CC BY 4.0.", None, "b"), (8, "Prosa", "de", "b"), (9, "prose", "en", "b"), (10, "no language", None, "b"),
    (11, "Was orer.\n" + GPL, "en", "c"), (12, "prose", "en", "c"), (13, "Released under the MIT License.", "en", None), (14, "prose", "en", None), (15, "", "fr", None),
    (16, GPL, "en", "d"), (17, APACHE, "en", "d"), (18, "prose", "en", "d"), (19, "prose", "en", "bc"),
]


def brute_scan(text):
    """Licence by the best line, paragraph, header or whole text, and whether the whole text is a licence alone."""
    lines = (text or "").split("\n")
    blocks = [*lines, *(p.replace("\n", " ") for p in "\n".join(x.strip() for x in lines).split("\n\n")), " ".join(lines[: lic.HEADER_LINES]), text or ""]
    score, name = max(((brute_cosine(b, t), -i) for b in blocks for i, (_, t) in enumerate(lic.TEMPLATES)))
    whole = max(brute_cosine(text or "", t) for _, t in lic.TEMPLATES)
    if score < lic.THRESHOLD - 1e-9:
        return None, score, False
    return lic.TEMPLATES[-name][0], score, whole >= (lic.THRESHOLD if sum(lic.terms(text).values()) >= lic.NOTICE else lic.ALONE) - 1e-9


def test_query_inherits(spark, tmp_path):
    """Documents that are a licence alone give it to those without one in their directory and below; the whole query against brute force."""
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lic.op1_licenses(spark, str(tmp_path)).collect()}
    assert got.keys() == {d[0] for d in DOCUMENTS}
    own = {i: brute_scan(t) for i, t, _, _ in DOCUMENTS}
    where = {i: [s or "unknown", *([g] if g else [])] for i, _, g, s in DOCUMENTS}
    heirs = 0
    for i in own:
        want, source = own[i][0], None
        for k in range(len(where[i]), 0, -1) if want is None else ():
            files = [(-round(own[j][1], 9), "/".join([*where[j], f"{j}.txt"]), own[j][0]) for j in own if own[j][2] and where[j] == where[i][:k]]
            if files:
                _, source, want = min(files)
                break
        assert (got[i].own_license, got[i].license, got[i].inherited_from) == (own[i][0], want, source), (i, got[i])
        heirs += source is not None
    assert heirs == 7 and got[2].license == "MIT" and got[8].license == "GPL-3.0" and got[9].license == "CC-BY-4.0" == got[10].license
    assert got[4].license is None and got[12].license is None and got[15].license is None and got[19].license is None


def test_by_text(spark):
    """Files named as licence files come before those known by their text, which count only if asked for."""
    files = spark.createDataFrame([(1, "x/LICENSE", "Notice of old\n" + GPL), (2, "x/a.txt", MIT), (3, "x/b.txt", "code"), (4, "y/c.txt", MIT), (5, "y/d.txt", "code"), (6, None, MIT), (7, "e", "code")], "doc_id long, path string, text string")
    of = lambda **k: {r.doc_id: (r.license, r.inherited_from) for r in lic.license_scan(files, **k).collect()}
    assert of()[3] == ("GPL-3.0", "x/LICENSE") == of(by_text=True)[3]
    assert of()[5] == (None, None) and of(by_text=True)[5] == ("MIT", "y/c.txt")
    assert of(by_text=True)[7] == (None, None)
