import random

import pytest

from claimscope.llm import licenses, tokens
from tests.llm.helpers import documents, edge_texts, words


def test_license_lines_are_found_with_their_place(spark):
    rng = random.Random(1)
    texts = []
    for i, (name, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        texts.append((i, f"{' '.join(words(rng, 9))}\n{t}\n{' '.join(words(rng, 9))}"))
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i, (name, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        assert got[i].license == name and got[i].block_no == 1 and texts[i][1][got[i].start :].startswith(t) and not got[i].missing and not got[i].extra


def test_wording_differences_decide(spark):
    texts = [(1, "Released under the MIT License"), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "a license to kill"), (4, "Copyright 2020 me. Licensed under CC BY-NC 4.0. Bye"), (5, "Licensed under CC BY-ND 4.0."), (6, None), (7, "")]
    got = {r.doc_id: r.license for r in licenses.scan(documents(spark, texts)).collect()}
    assert got == {1: "MIT", 2: "GPL-2.0", 4: "CC-BY-NC-4.0"}


def test_license_edges(spark):
    assert licenses.scan(documents(spark, edge_texts())).count() == 0 and licenses.scan(documents(spark, [])).count() == 0
    again = documents(spark, [(1, "All rights reserved.\n" * 3)] * 2)
    assert licenses.scan(again).count() == 6


def test_wrapped_notices_and_several_in_one_text(spark):
    grant, apache = licenses.TEMPLATES["MIT-grant"].split(), licenses.TEMPLATES["Apache-2.0-notice"].split()
    wrap = lambda ws, n, mark: "\n".join(mark + " ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    many = " ".join(f"{' '.join(words(random.Random(i), 12))} {t}" for i, t in enumerate(licenses.TEMPLATES.values()))
    texts = [
        (1, "MIT License\n\n" + wrap(grant, 11, "") + "\nmore"),
        (2, wrap(apache, 1, " * ")),
        (3, "Text under license: Licensed under CC BY 4.0. The code is\nReleased under the MIT License. All rights\nreserved."),
        (4, many),
        (5, "All rights reserved. " * 4),
        (6, wrap(grant[:8] + ["really"] + grant[8:20] + grant[21:], 5, "# ")),
    ]
    got = {}
    for r in licenses.scan(documents(spark, texts)).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r)
    names = {i: [r.license for r in rows] for i, rows in got.items()}
    assert names == {1: ["MIT-grant"], 2: ["Apache-2.0-notice"], 3: ["CC-BY-4.0", "MIT", "All-rights-reserved"], 4: list(licenses.TEMPLATES), 5: ["All-rights-reserved"] * 4, 6: ["MIT-grant"]}
    assert got[1][0].block_no == 2 and got[1][0].start == 13 and [r.start for r in got[5]] == [0, 21, 42, 63]
    assert got[6][0].extra == ["really"] and got[6][0].missing == [licenses.words(" ".join(grant))[20]]


PIECES = {p: s for p, s in [("▁", -9.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -4.5), ("ba", -5.0), ("aba", -7.0), ("▁ab", -6.0), ("bb", -8.0)]}


def brute_force(word):
    """Tokens of the best segmentation, over all of them."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + tokens.UNKNOWN * n, best[end - 1][1] + n)]
        ways += [(best[i][0] + PIECES[word[i:end]], best[i][1] + 1) for i in range(end) if word[i:end] in PIECES]
        best[end] = min(ways, key=lambda w: (-w[0], w[1]))
    return best[len(word)][1]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(seed):
    rng = random.Random(seed)
    ws = sorted({tokens.MARK + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 12))) for _ in range(200)})
    trie = tokens.Trie(PIECES)
    assert [trie.insert(w) for w in ws] == [brute_force(w) for w in ws]
    assert trie.nodes < sum(map(len, ws))  # prefixes are shared


def test_token_counts(spark):
    got = sorted((tuple(r) for r in tokens.token_counts(documents(spark, edge_texts())).collect()), key=str)
    pieces = tokens.load_pieces(tokens.default_model())
    want = sorted(((i, len((t or "").split()), sum(tokens.Trie(pieces).insert(tokens.MARK + w) for w in (t or "").split())) for i, t in edge_texts()), key=str)
    assert got == want
    assert tokens.token_counts(documents(spark, [])).count() == 0
