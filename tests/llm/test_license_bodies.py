"""Whole license texts, wrapped notices and typographic punctuation."""

import textwrap
from pathlib import Path

from cardloom.llm import license_scan

FOLDER = Path(license_scan.__file__).parent / "licenses"
DOCS = "doc_id long, text string"


def test_whole_texts_in_any_wrapping_and_punctuation(spark):
    texts, want = [], []
    for path in sorted(FOLDER.glob("*.txt")):
        body = path.read_text()
        head = "Copyright (c) 2019 Some Body\n© 2020 Another\n\nAll rights reserved.\n\n" if path.stem in license_scan.TITLES else ""
        curly = body.replace('"', "”").replace("'", "’").replace("--", "—")
        # a copyright line ends a paragraph of its own, so it is left as it is
        wrapped = "\n\n".join(p if "Copyright (C)" in p else textwrap.fill(p, 50) for p in body.split("\n\n"))
        texts += [body, head + curly, head + wrapped, body + " and more"]
        want += [path.stem, path.stem, path.stem, None]
    texts += [f"The MIT License (MIT)\n\nCopyright (c) 2019 Some Body\n\n{(FOLDER / 'MIT.txt').read_text()}"]
    want += ["MIT"]
    got = {r.doc_id: r.text_license for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_wrapped_notices_are_found_as_paragraphs(spark):
    texts = ["prose\n\nReleased under the\nMIT License.\n\nprose", "• Released under the “MIT” License…", "prose\nReleased under the\nMIT License.\nprose"]
    got = {r.doc_id: (r.line_licenses, r.n_license_lines) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {0: ("MIT", 1), 1: ("MIT", 1), 2: ("", 0)}
