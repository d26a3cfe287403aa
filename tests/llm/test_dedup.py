"""Near-duplicates, recurring runs and embeddings against brute force on small fixtures."""

import random

import numpy as np

from molq.llm.common import components
from molq.llm.near_dedup import near_duplicate_entities
from molq.llm.phrase_dedup import PhraseAutomaton, remove_recurring_runs
from molq.llm.vector_dedup import near_duplicate_profiles

DRAW = random.Random(4)
GENES = [f"GENE{i:03d}" for i in range(60)]


def texts_with_copies(n: int = 60) -> list[tuple[int, str | None]]:
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        kind = i % 6
        if rows and kind in (1, 2) and (base := rows[DRAW.randrange(len(rows))][1]):
            words = base.split()
            for _ in range(kind - 1 and max(1, len(words) // 40)):
                words[DRAW.randrange(len(words))] = DRAW.choice(GENES)
            rows.append((1000 - 7 * i, " ".join(words).swapcase() if i % 12 == 1 else " ".join(words)))
        else:
            rows.append((1000 - 7 * i, " ".join(DRAW.choices(GENES, k=DRAW.choice([1, 3, 12, 30, 80, 160])))))
    return rows + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "A b"), (2004, "a B"), (2005, "x " * 30000)]


def brute_groups(pairs: set[tuple], ids) -> dict:
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingles(text: str | None) -> set:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_match_brute_force(frame):
    rows = texts_with_copies()
    got = {r.cell_id: r for r in near_duplicate_entities(frame(rows, "cell_id bigint, features string"), percent=85).collect()}
    sets = {i: shingles(t) for i, t in rows}
    pairs = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    low = brute_groups(pairs, sets)
    assert len(got) == len(rows) and pairs
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), low[i], low[i] == i)


def test_near_duplicates_of_one_long_family(frame, monkeypatch):
    """Blocks far smaller than the family: links are found between blocks, too."""
    from molq.llm import near_dedup
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    base = DRAW.choices(GENES, k=100)
    rows = [(i, " ".join(base[:i % 17] + ["odd"] + base[i % 17 + 1:])) for i in range(40)]
    got = near_duplicate_entities(frame(rows, "cell_id int, features string"), percent=80).collect()
    assert {r.component_id for r in got} == {0}


def test_near_duplicates_edges(frame):
    rows = [("b", "u v w x y z", 1), ("a", "u v w x y z", 2), ("a", "u v w x y z", 2), (None, "u v w x y z", 3), ("c", None, 4)]
    got = near_duplicate_entities(frame(rows, "cell_id string, features string, kept int"))
    assert got.columns == ["cell_id", "n_shingles", "component_id", "kept"]
    seen = sorted((str(r.cell_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect())
    assert seen == [("None", 2, "None", True), ("a", 2, "a", True), ("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True)]
    assert near_duplicate_entities(frame([], "cell_id bigint, features string")).collect() == []


def test_components_of_a_long_chain(frame):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(frame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def brute_removed(rows: list[tuple], width: int = 13) -> dict:
    first: dict[tuple, object] = {}
    words = {i: (t or "").split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def runs_with_copies() -> list[tuple]:
    pool = [DRAW.choices(GENES, k=40) for _ in range(5)]
    rows = []
    for i in range(40):
        words: list[str] = []
        for _ in range(DRAW.randrange(4)):
            part = DRAW.choice(pool)
            cut = DRAW.randrange(20)
            words += DRAW.choices(GENES, k=DRAW.randrange(9)) + part[cut:cut + DRAW.randrange(10, 40)]
        rows.append((i * 3, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "é " * 12), (503, "aa " * 3000), (504, "aa " * 2000 + "bb " * 14), (505, "bb\t" * 13 + "cc")]


def test_recurring_runs_match_brute_force(frame, monkeypatch):
    from molq.llm import phrase_dedup
    monkeypatch.setattr(phrase_dedup, "CHUNK_BYTES", 2000)
    rows = runs_with_copies()
    want = brute_removed(rows)
    got = remove_recurring_runs(frame(rows, "cell_id bigint, features string")).collect()
    assert {r.cell_id: (r.n_words, r.n_removed, r.kept_features) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 500


def test_recurring_runs_with_text_ids_and_carried_columns(frame):
    run = " ".join(GENES[:20])
    rows = [("c10", "x " + run, 1, "p"), ("c9", run + " y", 2, None), (None, run, 3, "q"), ("c10", "x " + run, 4, "r"), ("c8", None, 5, "s")]
    data = frame(rows, "cell_id string, features string, n_words int, chunk string")
    got = remove_recurring_runs(data, carry=["chunk"]).collect()
    seen = sorted((str(r.cell_id), r.n_words, r.n_removed, r.kept_features, str(r.chunk)) for r in got)
    assert seen == [("None", 20, 0, run, "q"), ("c10", 21, 0, "x " + run, "p"), ("c10", 21, 0, "x " + run, "r"),
                    ("c8", 0, 0, "", "s"), ("c9", 21, 20, "y", "None")]
    assert remove_recurring_runs(frame([], "cell_id bigint, features string")).collect() == []


def test_automaton_compares_words_in_full():
    passages = [" ".join(GENES[:30]), "é " + " ".join(GENES[5:25])]
    found = PhraseAutomaton(passages, 13).locate("zz " + " ".join(GENES[3:20]) + " " + " ".join(GENES[:13]) + " GENE0")
    assert np.flatnonzero(found).tolist() == [1, 2, 3, 4, 5, 18]
    assert not PhraseAutomaton([], 13).locate(passages[0]).any()
    assert PhraseAutomaton(["a " * 39 + "a"], 13).locate("a " * 19 + "a").all()


def vectors() -> list[tuple]:
    draw = np.random.default_rng(3)
    rows = []
    for i in range(300):
        if i % 5 == 0 or not rows:
            v = draw.normal(size=16)
        else:
            v = np.array(rows[draw.integers(len(rows))][1]) + draw.normal(size=16) * draw.choice([0, 0.1, 0.35])
        rows.append((int(3 * (300 - i)), [float(np.float32(x)) for x in v], int(i % 3)))
    return rows


def test_profiles_match_brute_force(frame, monkeypatch):
    from molq.llm import vector_dedup
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    monkeypatch.setattr(vector_dedup, "LEAF", 4)
    rows = vectors()
    got = {r.cell_id: r for r in near_duplicate_profiles(frame(rows, "cell_id bigint, embedding array<float>, cell_type int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    low = brute_groups({(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))}, ids)
    assert near.sum() > 100
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), low[i], low[i] == i)


def test_profiles_edges(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a", 9), (2, [2.0, 0.0], "a", 9), (3, [1.0, 0.0], "b", 9), (4, None, "a", 9), (5, [0.0, 0.0], "a", 9), (6, [nan, 1.0], "a", 9),
            (7, [1.0, None], "a", 9), (8, [1.0, 0.0], None, 9), (9, [1.0, 0.0, 0.0], "a", 9), (10, [], "a", 9), (11, [inf, 1.0], "a", 9),
            (None, [1.0, 0.0], "a", 9), (1, [1.0, 0.0], "a", 9)]
    got = near_duplicate_profiles(frame(rows, "cell_id bigint, embedding array<double>, cell_type string, n_links int"))
    seen = sorted((r.cell_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got.collect())
    assert seen == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in range(3, 12)]]
    empty = frame([], "cell_id bigint, embedding array<float>, cell_type int")
    assert near_duplicate_profiles(empty).collect() == []


