import random

from revscope.llm import passages
from revscope.llm.common import word_hashes

SCHEMA = "doc_id long, text string, start string, words int, kept int, n_chars long"


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def fixture():
    rng = random.Random(2)
    rows, holds = [], {}
    shared = [text_of(rng, 51 + 7 * i) for i in range(12)]
    for i in range(60):
        lines = [text_of(rng, rng.choice([8, 40, 90])) for _ in range(rng.randint(1, 6))]
        if i < 48:
            p = shared[i % 12]
            at = rng.randrange(len(lines))
            if i % 3 == 0:
                lines.insert(at, p)  # a line of its own
            else:
                words = lines[at].split(" ")
                k = rng.randrange(len(words))
                lines[at] = " ".join([*words[:k], p, *words[k:]])
            holds[i] = i % 12
        rows.append((i, "\n".join(lines)))
    return rows, holds, shared


def test_planted_passages_are_found_and_nothing_else(spark):
    rows, holds, shared = fixture()
    rows += [(100, None), (101, ""), (102, "a b c"), (103, "a b c"), (104, "again " * 40 + "\n" + "again " * 40), (105, "é" * 50_000)]
    data = [(i, t, "x", 1, 1, len(t or "")) for i, t in rows] + [(59, rows[59][1], "x", 1, 1, 0), (None, "no id " + shared[0], None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = passages.passages(df).collect()
    text = dict(rows) | {passages._LAST: "no id " + shared[0]}
    found = {}
    for r in got:
        p = shared[0 if r.id == passages._LAST else holds[r.id]]
        piece = text[r.id][r.start:r.end]
        assert piece.strip(" ") in p or r.kind == "paragraph" and p in piece, (piece, p)
        found.setdefault(r.id, []).append(r)
    assert set(found) == set(holds) | {passages._LAST}
    for i in holds:
        words = sum(r.words for r in found[i] if r.kind == "run")
        assert words >= 0.5 * len(shared[holds[i]].split())
        # the first document keeps its copy; a later one may keep an edge that the first has cut otherwise
        removed = sum(r.words for r in found[i] if not r.kept and r.kind == "run")
        assert removed == 0 if i < 12 else removed >= 0.4 * len(shared[holds[i]].split())
        assert {r.passage for r in found[i]} & {r.passage for r in found[holds[i]]}
    left = {r.doc_id: r for r in passages.without_repeats(df).collect()}
    assert set(left) | {None} == {r[0] for r in data}  # of the text without an id the whole line is a near copy
    for i, t in rows:
        if i not in holds or i < 12:
            assert left[i].text == t
        else:
            assert len(left[i].text) < len(t) and left[i].n_chars == len(left[i].text)


def test_near_equal_paragraphs_are_verified(spark):
    rng = random.Random(3)
    line = text_of(rng, 120)
    changed = line.split(" ")
    changed[60] = "other"
    far = line.split(" ")
    for k in range(5, 120, 12):
        far[k] = "x%d" % k
    rows = [(1, "start here\n" + line), (2, " ".join(changed) + "\nend"), (3, " ".join(far))]
    got = passages.passages(spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], SCHEMA)).filter("kind = 'paragraph'").collect()
    assert sorted((r.id, r.kept, r.words) for r in got) == [(1, True, 120), (2, False, 120)]
    assert dict(rows)[1][got[0].start:got[0].end] == line or dict(rows)[2][got[0].start:got[0].end] == " ".join(changed)


def test_blocks_do_not_depend_on_what_stands_around():
    import numpy as np

    rng = random.Random(5)
    p = text_of(rng, 200)
    cuts = []
    for before, after in (("", ""), ("some words before ", " and after"), ("x " * 50, "")):
        raw = np.frombuffer((before + p + after).encode(), np.uint8)
        lines = passages._Lines(raw, np.array([0, len(raw)]))
        first = lines.blocks()
        n = len(word_hashes(np.frombuffer(before.encode(), np.uint8), np.array([0, len(before)]))[0]) if before else 0
        cuts.append({int(f) - n for f in first if 5 <= f - n < 190})
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) > 10


def test_cut_keeps_lines():
    assert passages._cut("a b c d\ne f\ng", [(2, 5), (8, 11)]) == "a d\ng"
    assert passages._cut("abc", [(0, 3)]) == "" and passages._cut("abc", []) == "abc"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert passages.passages(df).count() == 0 and passages.without_repeats(df).count() == 0


def lines_of(rng, words, low, high):
    out, words = [], list(words)
    while words:
        n = rng.randint(low, high)
        out.append(" ".join(words[:n]))
        words = words[n:]
    return "\n".join(out)


def test_passages_of_short_lines_are_found(spark):
    rng = random.Random(6)
    rows, whole = [], {}
    for j, (low, high) in enumerate([(1, 4), (3, 4), (2, 3), (1, 12), (4, 5)]):
        p = lines_of(rng, text_of(rng, 80).split(" "), low, high)
        for i in (10 * j, 10 * j + 1):
            rows.append((i, text_of(rng, 30) + "\n" + p + "\n" + lines_of(rng, text_of(rng, 40).split(" "), low, high)))
            whole[i] = p
    got = passages.passages(spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], SCHEMA)).filter("NOT kept").collect()
    text = dict(rows)
    for i in whole:
        mine = [r for r in got if r.id == i]
        if i % 10 == 0:
            assert not mine
            continue
        covered = set()
        for r in mine:
            covered.update(range(r.start, r.end))
        at = text[i].index(whole[i])
        inside = sum(x in covered for x in range(at, at + len(whole[i])))
        assert inside >= 0.75 * len(whole[i]) and len(covered) - inside <= 12, i


def test_recall_of_near_equal_lines(spark):
    rng = random.Random(7)
    rows, pairs = [], {}

    def jaccard(a, b):
        grams = [{tuple(t.lower().replace(".", "").replace(",", "").split(" ")[i:i + 5]) for i in range(len(t.split(" ")) - 4)} for t in (a, b)]
        return len(grams[0] & grams[1]) / len(grams[0] | grams[1])

    for kind, (n, edits) in enumerate([(16, [15]), (24, [0, 23]), (40, [39]), (60, [30])]):
        for k in range(60):
            words = text_of(rng, n).split(" ")
            other = list(words)
            for e in edits:
                other[e] = f"other{rng.randrange(10**6)}"
            a, b = " ".join(words), " ".join(other)
            i = 1000 * kind + 2 * k
            rows += [(i, a + "\n" + text_of(rng, 20)), (i + 1, text_of(rng, 20) + "\n" + b)]
            assert jaccard(a, b) >= 0.8
            pairs[i] = kind
    got = passages.passages(spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], SCHEMA)).filter("kind = 'paragraph'").collect()
    joined = {}
    for r in got:
        joined.setdefault(r.passage, set()).add(r.id)
    together = {frozenset(x) for x in joined.values()}
    assert all(len(x) == 2 and max(x) - min(x) == 1 for x in together)  # nothing else is joined
    for kind in range(4):
        mine = [i for i, k in pairs.items() if k == kind]
        assert sum(frozenset((i, i + 1)) in together for i in mine) >= 0.9 * len(mine), kind
