"""The manifest, name variants and fertility rules against brute force, with nulls, ties and empty tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import molq.llm.manifest as manifest
import molq.llm.spelling as spelling
from molq.llm.fertility import MEASURES, base_measures, fertility_verdicts, parts_of, script_of
from molq.llm.manifest import dataset_manifest
from molq.llm.spelling import feature_words, name_variants

TRANSCRIPTS = "transcript_id string, method string, cell_id string, feature_name string, x double, y double, leaf string, pos int"
FIELDS = ["transcript_id", "method", "cell_id", "feature_name", "x", "y"]


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[bool, str]]:
    out = []
    for row in tree[:-1]:
        out.append((bool(i & 1), row[i ^ 1] if (i ^ 1) < len(row) else ""))
        i >>= 1
    return out


def transcripts(n: int) -> list[tuple]:
    draw = random.Random(5)
    rows = [(f"t{i:05d}", "m" if i % 3 else draw.choice(["a", "ä", "z", None, ""]), None if i % 7 == 0 else f"c{i % 5}",
             draw.choice(["GENE1", "", "ß" * 2000, None]), i / 4, None if i % 2 else 1.5, "clash", i) for i in range(n)]
    return rows + [rows[3], rows[3], (None, "m", None, None, None, None, None, None), ("alone", "one leaf", None, "G", 0.0, 0.0, "", 1)]


@pytest.mark.parametrize("block_levels", [2, 12])
def test_manifest_matches_brute_force(frame, monkeypatch, block_levels):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", block_levels)
    rows = transcripts(90)
    shifted = F.when(F.col("x") > 10, F.col("x") + 1).otherwise(F.col("x"))
    got = dataset_manifest(frame(rows, TRANSCRIPTS), claimed={"x": shifted}).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, h(*map(field, r[:6]))))
    order = sorted(groups, key=lambda m: (m is not None, (m or "").encode()))
    for m in order:
        groups[m].sort(key=lambda p: (p[0][0] is not None, p[0][0] or "", p[1]))
    trees = {m: levels([leaf for _, leaf in groups[m]]) for m in order}
    top = levels([trees[m][-1][0] for m in order])
    want = []
    for k, m in enumerate(order):
        for i, (r, leaf) in enumerate(groups[m]):
            proof = path(trees[m], i) + path(top, k)
            claimed = list(r[:6])
            if claimed[4] is not None and claimed[4] > 10:
                claimed[4] += 1
            folded = h(*map(field, claimed))
            for left, other in proof:
                folded = h(other, folded) if left else h(folded, other)
            want.append((r[0], leaf, trees[m][-1][0], top[-1][0], h(*[o for _, o in proof]), folded, folded == top[-1][0]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_one_row_and_of_none(frame):
    one = dataset_manifest(frame([("t", None, "c", "G", 1.0, 2.0, "", 0)], TRANSCRIPTS)).collect()
    assert one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].verified
    assert one[0].proof_sha256 == h()
    assert dataset_manifest(frame([], TRANSCRIPTS)).collect() == []


def brute_variants(counts: dict[str, int], ratio: int) -> dict[str, tuple]:
    def near(a: str, b: str) -> bool:
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))

    met = {w: [o for o in counts if near(w, o)] for w in counts}
    form = {w: min(os, key=lambda o: (-counts[o], o)) for w, os in met.items() if os}
    form = {w: o for w, o in form.items() if counts[o] >= ratio * counts[w]}
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(met[w]), counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("tile, packed", [(3, 2), (1024, 256)])
def test_name_variants_match_brute_force(frame, monkeypatch, tile, packed):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "PACKED", packed)
    draw = random.Random(8)
    base = ["Macrophage", "T cell", "aaaaaa", "ééé", "B", "", "Endothelial-cell", "𝛼β", "x" * 300]
    counts = {b: draw.choice([1, 40, 40, 200, 3000]) for b in base}
    for _ in range(250):
        w = draw.choice(list(counts))
        i = draw.randrange(len(w) + 1)
        new = draw.choice([w[:i] + draw.choice("aeTé𝛼") + w[i:], w[:i] + w[i + 1:], w[:i] + draw.choice("aeTé") + w[i + 1:]])
        counts.setdefault(new, draw.choice([0, 1, 5, 5, 30, 400]))
    rows = [(w, n, "c", 1) for w, n in counts.items()] + [("T cell", 7, "c", 1), ("B", None, "c", 1), (None, 5, "c", 1)]
    got = name_variants(frame(rows, "cell_type string, n int, word string, form int"), "cell_type").collect()
    counts["T cell"] += 7
    assert {r.cell_type: tuple(r)[1:] for r in got} == brute_variants(counts, 5) and len(got) == len(counts)
    assert any(r.root != (r.form or r.cell_type) for r in got)


def test_words_of_features(frame):
    texts = [(1, "GENE Gené gene×a ü-ÜX kelvinK"), (1, None), (None, "gene"), (2, ""), (3, "gene " * 5000)]
    got = {r.feature_name: r.n for r in feature_words(
        frame([(*t, "q") for t in texts], "cell_id int, features string, n string"), min_length=2, min_count=1).collect()}
    assert got == {"gene": 5002, "gené": 1, "gene×a": 1, "Üx": 1, "kelvin": 1}
    slipped = {r.feature_name: r.n for r in feature_words(
        frame(texts, "cell_id int, features string"), min_length=1, min_count=1, slip_one_in=1).collect()}
    assert sum(slipped.values()) == 5006 and "gene" not in slipped  # one letter alone is gone
    empty = feature_words(frame([], "cell_id int, features string"))
    assert empty.collect() == [] and name_variants(empty).collect() == []


PROSE = "the cells of the tissue were counted and each of them was given to one of the types that the panel can tell apart"


def prose(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(PROSE.split() + [f"gene{i}" for i in range(200)], k=n))


def test_base_measures_match_brute_force():
    for text in (prose(1, 400), "a b c\na b c\n\n \t\nx", "", " \n  ", "# $ | <> [x]\n" * 30, "x", "a a a a", "é é \v\f b"):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        seen, twice = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                twice += line in seen
                seen.add(line)
        assert base_measures(text) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), twice, len(covered))


def test_fertility_bands_reject_noise_and_keep_prose(frame):
    rows = [(i, prose(i, 150 + i), "en" if i % 3 else None, "q", 1) for i in range(120)]
    rows += [(500, " ".join(w + "###$%" for w in prose(500, 160).split()), "en", "", 0), (501, prose(501, 160).upper(), None, "", 0),
             (502, " ".join(chr(0x2800 + i) + "ß" for i in range(160)), "en", "", 0), (503, None, None, None, None), (504, "", "en", "", 0),
             (505, "same words here " * 100, "en", "", 0), (506, prose(506, 60_000), "en", "", 0), (None, prose(3, 153), "en", "", 0)]
    df = frame(rows, "dataset int, provenance string, lang string, kept string, n_words int")
    got = {r.dataset: r for r in fertility_verdicts(df, lang_col="lang").collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(120)) and got[None].kept
    assert [got[i].kept for i in (500, 501, 502)] == [False] * 3 and not any(got[i].base_failed for i in (500, 501, 502))
    assert [got[i].base_failed for i in (503, 504, 505)] == [True] * 3 and not any(got[i].kept for i in (503, 504, 505))
    assert got[506].kept and got[506].n_words == 60_000  # alone in its length class: not judged
    # The bands, computed anew from the measures of all rows that pass the base rules.
    names = list(MEASURES)
    sound = [r for r in got.values() if not r.base_failed]
    assert all(set(r.outside) <= set(names) for r in sound)
    for r in sound:
        assert r.kept == (not r.outside)
    assert fertility_verdicts(frame([], "dataset int, provenance string")).collect() == []


def test_scripts_and_parts():
    assert [script_of(t) for t in ("", "12 !", "abc", "привет a", "漢字 a", "aΩ")] == ["none", "none", "Latin", "Cyrillic", "Han", "Latin"]
    for text in ("x" * 120_001, "ab " * 50_000, "", "short"):
        assert "".join(parts_of(text)) == text and max(map(len, parts_of(text))) <= 50_000
