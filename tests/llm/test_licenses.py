import re
import textwrap

from heddle.llm.licenses import KNOWN, full_texts, known, license_scan


def scan(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as license", "2 as Digest", "3 as row")
    return sorted((tuple(r) for r in license_scan(docs, known(spark)).collect()), key=str)


def test_whole_texts_and_lines(spark):
    mit = next(text for _, text in KNOWN if text.startswith("Permission is hereby"))
    wrapped = "  MIT-like text\n" + mit
    variant = "Copyright (c) 2019 Some One\nAll rights reserved.\n# " + mit.upper().replace(", ", ",\n * ").replace("SUBLICENSE", "SUBLICENCE")
    rows = [
        (1, mit),
        (2, variant),
        (3, wrapped),
        (4, "prose here\nreleased under the mit licence\nMore. Licensed under CC BY-NC 4.0!\nLicensed under CC BY-NC 4.0!"),
        (5, None),
        (6, ""),
        (7, "...\n---"),
        (None, "Released under the MIT License."),
        (8, "a"),
        (8, "a"),
    ]
    assert scan(spark, rows) == sorted(
        [
            (1, "MIT", 1, "MIT"),
            (2, "MIT", 0, ""),
            (3, None, 1, "MIT"),
            (4, None, 2, "CC-BY-NC-4.0,MIT"),
            (5, None, 0, ""),
            (6, None, 0, ""),
            (7, None, 0, ""),
            (None, "MIT", 1, "MIT"),
            (8, None, 0, ""),
            (8, None, 0, ""),
        ],
        key=str,
    )


def test_empty_and_repeated_hits(spark):
    assert scan(spark, []) == []
    line = "Released under the MIT License."
    assert scan(spark, [(1, "x\n" + line)] * 3) == [(1, None, 1, "MIT")] * 3
    assert scan(spark, [(1, "word " * 20000 + "\n" + line)]) == [(1, None, 1, "MIT")]


def test_license_files(spark):
    shipped = dict(full_texts())
    asked = {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"}
    assert asked <= set(shipped)
    bodies = {name: next(x for n, x in full_texts() if n == name) for name in asked}
    wrapped = lambda text: "\n".join(textwrap.wrap(text, 78))
    owner = "Copyright (c) 2021 Some One\nAll rights reserved.\n\n"
    rows = [
        ("MIT", "MIT License\n\n" + owner + wrapped(bodies["MIT"])),
        ("MIT", "The MIT License (MIT)\n\n" + owner + wrapped(bodies["MIT"])),
        ("ISC", "ISC License\n\n" + owner + wrapped(bodies["ISC"])),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + owner + re.sub(r"(?m)^[1-3]\.", "*", bodies["BSD-3-Clause"])),
        ("BSD-2-Clause", owner + bodies["BSD-2-Clause"].replace('"AS IS"', "``AS IS''")),
        ("GPL-2.0", shipped["GPL-2.0"]),
        ("GPL-2.0", shipped["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA  02111-1307")),
        (None, "MIT License\n\n" + owner + wrapped(bodies["MIT"]) + "\nUnless it rains."),
        (None, shipped["GPL-3.0"][:-200]),
        (None, "MIT License"),
    ] + [(name, bodies[name]) for name in sorted(asked)]
    got = scan(spark, [(i, text) for i, (_, text) in enumerate(rows)])
    assert {r[0]: r[1] for r in got} == {i: name for i, (name, _) in enumerate(rows)}


def test_the_wrapping_does_not_count(spark):
    rows = []
    for name, text in full_texts():
        if "\n" not in text:  # what another is in one line
            continue
        body = text.split("\n\n")
        for width in (None, 10**7, 60, 100):
            wrapped = text if width is None else "\n\n".join(textwrap.fill(x, width, break_long_words=False) for x in body) if width < 10**7 else " ".join(text.split())
            rows += [(name, wrapped), (name, "Copyright (c) 2019-2021 Some One <one@example.com>\nCopyright Other, Inc. 2020\nAll rights reserved.\n\n" + wrapped)]
    got = scan(spark, [(i, text) for i, (_, text) in enumerate(rows)])
    lost = {rows[r[0]][0] for r in got if r[1] != rows[r[0]][0]}
    assert not lost
