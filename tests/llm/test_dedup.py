import hashlib
import math
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmine.llm import exact_dedup, line_dedup, simhash, substring_dedup
from quillmine.llm.common import connected_components


def rows(df):
    return df.collect()


def exact_brute(pairs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in pairs]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = min((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd)
    assert sorted(map(tuple, rows(got)), key=str) == exact_brute([(r["doc_id"], r["text"]) for r in rows(odd)])
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_tells_collisions_apart(odd):
    got = exact_dedup.exact_dedup(odd, hash_fn=lambda c: F.lit(b"same"))
    assert sorted(map(tuple, rows(got)), key=str) == exact_brute([(r["doc_id"], r["text"]) for r in rows(odd)])


def simhash_brute(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    for r in rows(odd):
        assert simhash.fingerprint(None if r["text"] is None else r["text"].encode()) == simhash_brute(r["text"])


def test_covering_masks_cover():
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(20 <= bin(m).count("1") <= 44 for m in masks)
        for flipped in itertools.combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in flipped) for m in masks)


def components_brute(fps, radius=2):
    label = {i: i for i in fps}
    ids = list(fps)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_join_all_within_the_radius(spark, bucket):
    rng = random.Random(bucket)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {}
    for i in range(90):
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps[i] = f
    distinct = {}
    for i, f in fps.items():
        distinct.setdefault(f, i)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for f, i in distinct.items()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, node long"), pair_bucket=bucket)
    found = {r["id"]: r["component"] for r in rows(connected_components(edges))}
    want = components_brute({i: f for f, i in distinct.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_dedup(odd, none, small, spark):
    got = rows(simhash.simhash_dedup(odd))
    assert len(got) == 10 and {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.simhash_dedup(none).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    fps = {i: simhash_brute(t) for i, t in texts.items()}
    want = components_brute(fps)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows(simhash.simhash_dedup(docs))}
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_keep_one(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in rows(kept)), key=str) == sorted([1, 4, 6, 7, 8, None], key=str)
    assert simhash.keep_one(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (3, 2)]
    got = {r["id"]: r["component"] for r in rows(connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


# ---- lines


def lines_brute(table, sites, share=line_dedup.DISTINCT_SHARE):
    strip, spread = (lambda x: x.strip(" \t\n\v\f\r")), {}
    for _, text, source in table:
        lines = {strip(x) for x in (text or "").split("\n")} - {""}
        at = sorted((-math.log((int(hashlib.md5(x.encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / len(x), x) for x in lines)
        for x in lines:
            rest = [y for _, y in at if y != x][:1]
            s = spread.setdefault(x, (set(), set(), [0]))
            s[0].add(source)
            s[1].update(rest)
            s[2][0] += 1
    gone = {x for x, (s, c, n) in spread.items() if len(s) >= sites and len(c) >= max(sites, math.ceil(n[0] * share))}
    out = []
    for i, text, _ in table:
        lines = text.split("\n") if text is not None else []
        stay = [x for x in lines if strip(x) not in gone]
        out.append((i, None if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_line_dedup(spark, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rng = random.Random(4)
    table = []
    for i in range(120):
        own = [f"own line {i} {j} " + "x" * rng.randint(0, 30) for j in range(rng.randint(0, 4))]
        shared = [f"shared {k}" for k in range(8) if rng.random() < k / 10]
        body = own + [" " * rng.randint(0, 2) + s for s in shared] + [""] * rng.randint(0, 1)
        rng.shuffle(body)
        table.append((i, "\n".join(body) if i % 17 else None, rng.choice(["a", "b", "c", "d", None])))
    table += [(200 + i, "copied one\ncopied two that is longest", "abcd"[i % 4]) for i in range(30)]  # copies keep their lines
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = line_dedup.line_dedup(df, sites=4, broadcast_lines=broadcast)
    assert sorted(map(tuple, rows(got.select("doc_id", "text", "n_lines", "n_removed"))), key=str) == lines_brute(table, 4)
    kept = {r["doc_id"]: r["n_removed"] for r in rows(got)}
    assert all(kept[200 + i] == 0 for i in range(30)) and any(kept.values())


def test_line_dedup_odd(odd, none):
    for limit in (0, 100):
        got = line_dedup.line_dedup(odd, sites=1, broadcast_lines=limit)
        assert [c for c in got.columns if c not in ("n_lines", "n_removed")] == [c for c in odd.columns if c != "n_lines"]
        assert sorted(map(tuple, rows(got.select("doc_id", "text", "n_lines", "n_removed"))), key=str) == lines_brute([(r["doc_id"], r["text"], r["source"]) for r in rows(odd)], 1)
        assert line_dedup.line_dedup(none, broadcast_lines=limit).count() == 0
    assert line_dedup.line_dedup(odd, counts=False).columns == odd.columns


def test_planted_boilerplate_goes_and_copies_stay(spark):
    """Notices on ten sites or more, short or the longest line of their pages, alone or with others of
    the same template, against exact and near copies of documents on as many sites."""
    rng = random.Random(8)
    word = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    notices = [word(60), word(4), word(30), word(9)]
    table, planted, clean = [], set(notices), set()
    for i in range(240):
        own = [word(rng.randint(4, 25)) for _ in range(rng.randint(2, 9))]
        clean.update(own)
        here = notices[:2] if i % 3 == 0 else [n for n in notices if rng.random() < 0.3]  # a template of two, or some
        table.append([*here[:1], *own, *here[1:]])
    for group in range(12):  # copies of a document; from the seventh on, a word of two lines differs in each
        own = [word(rng.randint(4, 25)) for _ in range(12)]
        for _ in range(30):
            lines = list(own)
            if group >= 6:
                for _ in range(2):
                    at = rng.randrange(len(lines))
                    lines[at] = lines[at].rsplit(" ", 1)[0] + " " + word(1)
            clean.update(lines)
            table.append(lines)
    rng.shuffle(table)
    data = [(i, "\n".join(x), f"s{i % 15}") for i, x in enumerate(table)]
    got = rows(line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string, source string")))
    gone = set().union(*(set(data[r["doc_id"]][1].split("\n")) - set(r["text"].split("\n")) for r in got))
    assert gone == planted and not gone & clean


# ---- passages


def windows_brute(h, span):
    out = set()
    for c in range(len(h)):
        left, right = c, c
        while left > 0 and h[left - 1] > h[c]:
            left -= 1
        while right < len(h) - 1 and h[right + 1] >= h[c]:
            right += 1
        if right - left + 1 >= span:
            out.add((left, c, right))
    return out


def test_compact_windows():
    rng = np.random.default_rng(2)
    for n, span in ((30, 5), (200, 12), (46, 46), (45, 46), (300, 46)):
        h = rng.integers(0, 40, n).astype(np.uint64) << np.uint64(20)
        got = substring_dedup.compact_windows(h, np.zeros(n, int), np.full(n, n), span)
        assert {tuple(x) for x in got.tolist()} == windows_brute(h.tolist(), span)


def test_signatures_hold_for_their_subsequences():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)).encode() for n in (0, 10, 50, 200, 400)]
    words, bounds = substring_dedup.WordHashes()(texts)
    assert list(np.diff(bounds)) == [0, 10, 50, 200, 400]
    text, key, centre, first, last = substring_dedup.signatures(words, bounds)
    for i in range(5):
        m = text == i
        starts = sorted(s for a, b in zip(first[m], last[m]) for s in range(a, b + 1))
        n = max(0, bounds[i + 1] - bounds[i] - 4 - 45)
        assert starts == sorted(list(range(n)) * substring_dedup.FUNCTIONS)  # each subsequence once under each function


def test_word_hashes_depend_on_the_words_alone():
    h = substring_dedup.WordHashes()
    a, ab = h([b"One  two\tTHREE", b"x three"])
    b, _ = h([b"zzz one two three"])
    assert a[:3].tolist() == b[1:].tolist() and a[2] == a[4] and ab.tolist() == [0, 3, 5]


def text_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_repeated_passages(spark):
    rng = random.Random(9)
    passage, other, near = text_of(rng, 60), text_of(rng, 50), text_of(rng, 120)
    docs = {i: text_of(rng, rng.randint(30, 200)) for i in range(40)}
    for i in (3, 7, 21):
        docs[i] = docs[i][:20] + passage + docs[i][20:]
    for i in (5, 9):
        docs[i] = docs[i] + other
    changed = list(near)
    changed[60] = "different"
    docs[11], docs[12] = text_of(rng, 10) + near, text_of(rng, 33) + changed + text_of(rng, 5)
    docs[30], docs[31] = [*docs[5]], [*docs[5]]  # copies
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(90, None), (91, ""), (None, "x")], "doc_id long, text string")
    got = rows(substring_dedup.repeated_passages(df))
    pairs = {}
    for r in got:
        assert r["rep_id"] < r["doc_id"] and r["similarity"] >= 0.8
        pairs.setdefault((r["doc_id"], r["rep_id"]), []).append((r["start"], r["end"], r["rep_start"], r["rep_end"]))
    assert set(pairs) == {(7, 3), (21, 3), (9, 5), (12, 11), (30, 5), (31, 5)}
    for i in (7, 21):
        assert pairs[i, 3] == [(20, 80, 20, 80)]
    n = len(docs[5])
    assert pairs[9, 5] == [(len(docs[9]) - 50, len(docs[9]), n - 50, n)] and pairs[30, 5] == [(0, n, 0, n)]
    assert min(x[0] for x in pairs[12, 11]) == 33 and max(x[1] for x in pairs[12, 11]) == 153


def verified(mine, theirs, start, lows, highs):
    """Passages, and which claims hold none."""
    scores = substring_dedup.similarities(mine, theirs, start, lows, highs)
    held = [bool(scores[a - start : b - start + 1].any()) if a <= b else False for a, b in zip(lows.tolist(), highs.tolist())]
    return substring_dedup.passages_of(scores, mine, theirs, start, 50), [not x for x in held]


def test_claims_and_verification():
    rng = random.Random(1)
    a, b = text_of(rng, 60), text_of(rng, 60)
    words, bounds = substring_dedup.WordHashes()([" ".join(a).encode(), " ".join(b).encode()])
    _, key, c, f, e = substring_dedup.signatures(words, bounds)
    place = substring_dedup.pack_place(c, f, e)
    assert [x.tolist() for x in substring_dedup.unpack_place(place)] == [c.tolist(), f.tolist(), e.tolist()]
    packed = substring_dedup.unpack_claims(substring_dedup.pack_claims(key, place, f.astype(np.int64), e.astype(np.int64)))
    assert [x.tolist() for x in packed] == [key.tolist(), place.tolist(), f.tolist(), e.tolist()]
    assert verified(words[:60].astype(np.uint32), words[60:].astype(np.uint32), 0, np.array([0]), np.array([10])) == ([], [True])
    assert verified(words[:60].astype(np.uint32), words[:60].astype(np.uint32), 0, np.array([0, 5]), np.array([10, 4])) == ([(0, 60, 1.0)], [False, True])


def test_a_passage_between_the_ends_of_a_place_is_verified():
    rng = random.Random(5)
    passage = text_of(rng, 50)
    mine, theirs = (" ".join(text_of(rng, 10) + passage + text_of(rng, 10)).encode() for _ in range(2))
    words, _ = substring_dedup.WordHashes()([mine, theirs])
    found, failed = verified(words[:70], words[70:], 0, np.array([0]), np.array([20]))
    assert [x[:2] for x in found] == [(10, 60)] and found[0][2] >= 0.8 and failed == [False]


def test_similarity_of_all_starts_is_jaccard():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 40, 120).astype(np.uint64)
    b = np.where(rng.random(120) < 0.1, rng.integers(0, 60, 120).astype(np.uint64), a)
    want = np.array([len(x & y) / len(x | y) for x, y in ((set(a[i : i + 30].tolist()), set(b[i : i + 30].tolist())) for i in range(91))])
    assert (want >= 0.8).any() and (want < 0.8).any()
    assert np.allclose(substring_dedup.jaccards(a, b, np.arange(91), 30), want)


def test_many_runs_at_once_are_each_run_alone():
    """Scores of runs that lie one after another, against sets of shingles of each run."""
    rng = random.Random(17)
    hashes, runs = substring_dedup.WordHashes(), []
    for i in range(60):
        mine = [rng.choice("abcdefgh") + str(rng.randrange(3 if i % 5 == 0 else 400)) for _ in range(rng.choice([0, 20, 50, 51, 90]))]
        theirs = edited(rng, mine, rng.randint(0, 2))[: len(mine)] if mine and i % 3 else [rng.choice(mine or "x") for _ in mine]
        theirs += ["pad"] * (len(mine) - len(theirs))
        low = rng.randint(0, max(0, len(mine) - 50))
        runs.append((mine, theirs, low, rng.randint(low - 1, max(low, len(mine) - 50))))
    words = lambda x: hashes([" ".join(x).encode()])[0].astype(np.uint32) if x else np.empty(0, np.uint32)
    sizes = np.array([len(m) for m, *_ in runs])
    begin = np.cumsum(sizes) - sizes
    got = substring_dedup.run_scores(
        np.concatenate([words(m) for m, *_ in runs]), np.concatenate([words(t) for _, t, *_ in runs]), begin, sizes, np.array([a for *_, a, _ in runs]), np.array([b for *_, b in runs]), np.arange(len(runs))
    )
    some = 0
    for (mine, theirs, low, high), at, n in zip(runs, begin, sizes):
        a, b = window_sets(mine)[1], window_sets(theirs)[1]
        for start in range(n):
            j = len(a[start] & b[start]) / len(a[start] | b[start]) if low <= start <= high and start < len(a) else 0.0
            assert got[at + start] == pytest.approx(j if j >= 0.8 else 0.0)
            some += 0.8 <= j < 1
    assert some > 5


def test_passages_of_fifty_words_are_always_found(spark):
    rng = random.Random(13)
    docs = []
    for i in range(150):
        passage = text_of(rng, 50)
        docs += [(2 * i + j, " ".join(text_of(rng, 60) + passage + text_of(rng, 60))) for j in (0, 1)]
    got = rows(substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {(r["doc_id"], r["rep_id"]) for r in got} == {(2 * i + 1, 2 * i) for i in range(150)}
    assert all(r["start"] <= 60 and r["end"] >= 110 and r["start"] == r["rep_start"] for r in got)


def test_places_of_a_key_with_other_words_are_kept(spark):
    """A phrase that holds the minimum and recurs among different items has places of its own."""
    rng = random.Random(21)
    hashes = substring_dedup.WordHashes()
    for _ in range(400):
        phrase = text_of(rng, 12)
        text = " ".join(w for _ in range(6) for w in phrase + text_of(rng, 12)).encode()
        words, bounds = hashes([text])
        _, key, centre, first, last = substring_dedup.signatures(words, bounds)
        want = {(k, p) for k, p in zip(key.tolist(), substring_dedup.pack_place(centre, first, last).tolist())}
        if len(set(key.tolist())) < len(want) - 2:
            break
    every = b"\xff" * 1024
    df = spark.createDataFrame([(1, bytearray(text)), (2, bytearray(b"same words again " * 200))], "doc long, text binary")
    got = rows(substring_dedup.signature_rows(df, among=every, thin=False))
    assert {(r["key"], r["place"]) for r in got if r["doc"] == 1} == want
    assert sum(r["doc"] == 2 for r in got) < 200  # of equal places one in each span


def test_what_is_not_verified_is_carried_on():
    keys, places = np.array([7, 8]), substring_dedup.pack_place(np.array([20, 40]), np.array([5, 38]), np.array([20, 39]))
    work = substring_dedup.Texts([(5, np.arange(200, dtype=np.uint64), [(1, 0, 10, substring_dedup.pack_claims(keys, places, places >> 16, places >> 16), b"")])], 46, 5)
    work.at, work.sizes, work.scores, work.covered = np.array([0]), np.array([10]), np.zeros(10), np.zeros(201, np.int64)
    work.scores[2:5] = 0.9  # starts 12 to 14

    def left(evidence):
        key, place, text = work.left(evidence)
        return list(zip(key.tolist(), *(x.tolist() for x in substring_dedup.unpack_place(place)), text.tolist()))

    assert left(1) == [(7, 20, 5, 11, 0), (7, 20, 15, 20, 0), (8, 40, 38, 39, 0)] and left(2) == []
    work.covered = np.minimum(np.maximum(np.arange(201) - 40, 0), 50)  # words 40 to 89 are found
    assert left(1) == [(7, 20, 5, 11, 0)]  # from 15 on half of the fifty words are


def test_near_passages_around_a_common_phrase_are_linked(spark):
    """Pairs of similar passages that share a phrase with all others, so that these win elections."""
    rng = random.Random(23)
    phrase, docs, n = text_of(rng, 34), [], 100
    for i in range(n):
        near = text_of(rng, 8) + phrase + text_of(rng, 8)
        for j in (0, 1):
            near[2] = f"v{i}x{j}"
            docs.append((i + n * j, " ".join(text_of(rng, 30) + near + text_of(rng, 30))))
    got = rows(substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    found = {(r["doc_id"], r["rep_id"]) for r in got}
    assert found <= {(i + n, i) for i in range(n)} and len(found) >= 0.95 * n


def test_chains_of_near_passages_are_linked(spark):
    """Passages A, B, C where B is similar to A and C to B, but not C to A, which comes first."""
    rng, docs, n = random.Random(41), [], 120
    for i in range(n):
        passage = text_of(rng, 50)
        for j, at in enumerate((None, 17, 33)):
            if at is not None:
                passage[at] = f"v{i}x{j}"
            docs.append((i + n * j, " ".join(text_of(rng, 40) + passage + text_of(rng, 40))))
    got = rows(substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {(r["doc_id"], r["rep_id"]) for r in got} == {(i + n * j, i + n * (j - 1)) for i in range(n) for j in (1, 2)}


def test_copies_and_variants_of_one_passage_are_one_class(spark):
    """Many copies of a passage, and variants that are similar to these and not to each other; the first is a variant."""
    rng, docs = random.Random(43), []
    base = text_of(rng, 50)
    for i in range(120):
        passage = list(base)
        if i % 3 == 0:
            passage[5 + i * 7 % 40] = f"v{i}"
        docs.append((i, " ".join(text_of(rng, 40) + passage + text_of(rng, 40))))
    got = rows(substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {r["component"] for r in rows(connected_components(spark.createDataFrame([(r["doc_id"], r["rep_id"]) for r in got], "a long, b long")))} == {0}
    assert {x for r in got for x in (r["doc_id"], r["rep_id"])} == set(range(120)) and all(r["rep_id"] < r["doc_id"] for r in got)


def test_lowest_shingles_of_similar_passages_meet(spark):
    """Subsequences of similarity 0.8 share two of their seven lowest shingles, whatever comes last."""
    rng, depth = np.random.default_rng(47), substring_dedup.depth_of(substring_dedup.SPAN, 0.8)
    assert depth == (7, 2)
    for _ in range(200):
        a = rng.integers(0, 1 << 60, 50).astype(np.uint64)
        b = a.copy()
        b[rng.integers(4, 46)] += np.uint64(1)
        common = rng.integers(0, 256, 512).astype(np.uint8)
        text, key, centre, first, last = substring_dedup.signatures(np.concatenate([a, b]), np.array([0, 50, 100]), depth=depth[0], common=common)
        assert (first == 0).all() and (last == 0).all() and [(text == i).sum() for i in (0, 1)] == [7, 7]
        assert len(set(key[text == 0].tolist()) & set(key[text == 1].tolist())) >= depth[1]


def test_what_only_one_document_has_makes_no_signatures(spark):
    """Phrases that two documents share, among words of their own, group nothing; a passage does."""
    rng, docs = random.Random(53), []
    for i in range(60):
        phrase, passage = text_of(rng, 20), text_of(rng, 50) if i % 10 == 0 else []
        docs += [(2 * i + j, " ".join(text_of(rng, 60) + phrase + text_of(rng, 60) + passage + text_of(rng, 60))) for j in (0, 1)]
    texts = spark.createDataFrame(docs, "doc long, text string").select("doc", F.col("text").cast("binary").alias("text"))
    got = rows(substring_dedup._repeated(texts, substring_dedup.SPAN, substring_dedup.SHINGLE, 7))
    ids = {}
    for r in got:
        ids.setdefault(r["key"], set()).add(r["doc"])
    several = {d for x in ids.values() if len(x) > 1 for d in x}
    assert several == {2 * i + j for i in range(0, 60, 10) for j in (0, 1)}


def test_lowest_of_each_subsequence():
    rng = np.random.default_rng(59)
    for n, span, depth in ((46, 46, 7), (47, 46, 7), (92, 46, 7), (1000, 46, 7), (70_000, 46, 7), (50, 8, 8), (20, 5, 1)):
        value = rng.permutation(n).astype(np.uint64)
        want = np.sort(np.lib.stride_tricks.sliding_window_view(value, span), axis=1)[:, depth - 1]
        assert (substring_dedup._kth_least(value, span, depth) == want).all()


def window_sets(words, span=substring_dedup.SPAN, size=substring_dedup.SHINGLE):
    """The sets of shingles of all windows."""
    low = [w.lower() for w in words]
    shingles = [tuple(low[i : i + size]) for i in range(len(low) - size + 1)]
    return shingles, [set(shingles[i : i + span]) for i in range(len(shingles) - span + 1)]


def best_of_windows(mine, theirs):
    """For each window of ``mine`` (sets) the best similarity to one of ``theirs`` (shingles, sets)."""
    shingles, sets = theirs
    out = []
    for a in mine:
        inside = np.concatenate([[0], np.cumsum([x in a for x in shingles])])
        shared = inside[substring_dedup.SPAN :] - inside[: -substring_dedup.SPAN] if len(inside) > substring_dedup.SPAN else []
        out.append(max((len(a & sets[t]) / len(a | sets[t]) for t in np.flatnonzero(np.asarray(shared) >= 0.7 * len(a))), default=0.0))
    return out


def caught(passages, start, wide=50, share=0.8):
    """Whether the words of a window lie in passages, this share of them or more."""
    held = set()
    for r in passages:
        held.update(range(max(start, r["start"]), min(start + wide, r["end"])))
    return len(held) >= share * wide


def test_passages_against_all_pairs(spark):
    """Of the documents whose id is divisible by 20, all windows against all of earlier documents."""
    docs = {r["doc_id"]: (r["text"] or "").split() for r in rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))}
    got = {}
    for r in rows(substring_dedup.repeated_passages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))):
        got.setdefault(r["doc_id"], []).append(r)
    holders, sets = {}, {}
    for i, words in docs.items():
        sets[i] = window_sets(words)
        for x in set(sets[i][0]):
            holders.setdefault(x, []).append(i)
    counts = {b: [0, 0] for b in (0.8, 0.85, 0.9, 0.95, 1.0)}
    wrong = clean = 0
    for i in sorted(d for d in docs if d % 20 == 0):
        met = {}
        for x in set(sets[i][0]):
            for j in holders[x]:
                met[j] = met.get(j, 0) + 1
        near = [j for j, n in met.items() if j < i and n >= 20]
        best = [max(x) for x in zip(*(best_of_windows(sets[i][1], sets[j]) for j in near))] if near else [0.0] * len(sets[i][1])
        for start, s in enumerate(best):
            bucket = max((b for b in counts if b <= s + 1e-9), default=None)
            if bucket:
                counts[bucket][0] += caught(got.get(i, []), start)
                counts[bucket][1] += 1
        clean += max(best, default=0) < 0.8
        wrong += max(best, default=0) < 0.8 and i in got
    print("caught of", counts, "clean documents", clean, "with a passage", wrong)
    assert sum(n for _, n in counts.values()) > 100 and not wrong
    assert all(c >= 0.9 * n for c, n in counts.values() if n >= 20), counts


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.6:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.8:
            out.insert(at, f"new{rng.randrange(10**6)}")
        else:
            del out[at]
    return out


def test_recall_by_similarity(spark):
    """Passages of 50 words, edited once or twice, in documents of other words."""
    rng, docs, truth, n = random.Random(31), [], {}, 700
    for i in range(n):
        passage = text_of(rng, 50)
        near = edited(rng, passage, 1 + i % 2)
        docs += [(i, text_of(rng, 60) + passage + text_of(rng, 60)), (n + i, text_of(rng, 70) + near + text_of(rng, 50))]
        truth[n + i] = max(best_of_windows(window_sets(docs[-1][1])[1], window_sets(docs[-2][1])))
    got = {(r["doc_id"], r["rep_id"]) for r in rows(substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")))}
    counts = {}
    for i, s in truth.items():
        if s >= 0.8:
            b = min(0.95, int(s * 20) / 20)
            c = counts.setdefault(b, [0, 0])
            c[0] += (i, i - n) in got
            c[1] += 1
    print({b: (c, n, round(c / n, 3)) for b, (c, n) in sorted(counts.items())})
    assert got <= {(i, i - n) for i in truth if truth[i] >= 0.8}
    assert counts[0.8][1] > 50 and all(c >= 0.9 * n for c, n in counts.values()), counts


def test_places_hold_all_their_starts():
    """A key is among the lowest of every subsequence that its places hold, and of no other one."""
    rng, span, depth = np.random.default_rng(61), substring_dedup.SPAN, 7
    words = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    _, key, centre, first, last = substring_dedup.signatures(words, np.array([0, 400]), depth=depth)
    with np.errstate(over="ignore"):
        value = substring_dedup._mix(substring_dedup.shingles(words) * substring_dedup._ODD)
    want = {(int(s + i), s) for s in range(len(value) - span + 1) for i in np.argsort(value[s : s + span])[:depth]}
    got = [(c, s) for c, f, e in zip(centre.tolist(), first.tolist(), last.tolist()) for s in range(f, e + 1)]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_around_a_common_passage_grow_with_its_texts(spark, monkeypatch):
    """What is compared of texts with one passage amid lines that some of them share, and that all are joined."""
    counts, pairs = [], substring_dedup._pairs

    def counted(*args):
        out = pairs(*args).cache()
        counts.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "_pairs", counted)
    compared = {}
    for n in (60, 240):
        rng, docs = random.Random(67), []
        base, lines = text_of(rng, 60), [text_of(rng, 12) for _ in range(n // 20)]
        for i in range(n):
            docs.append((i, " ".join(text_of(rng, 30) + lines[i % len(lines)] + base + lines[i // 20] + text_of(rng, 30))))
        counts.clear()
        got = rows(substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
        edges = spark.createDataFrame([(r["doc_id"], r["rep_id"]) for r in got], "a long, b long")
        assert [(r["id"], r["component"]) for r in sorted(rows(connected_components(edges)), key=lambda r: r["id"])] == [(i, 0) for i in range(n)]
        compared[n] = sum(counts)
    print(compared)
    assert compared[240] < 6 * compared[60] and compared[240] < 12 * 240


def test_repeated_passages_odd(odd, none):
    got = rows(substring_dedup.repeated_passages(odd))
    assert got == [] and substring_dedup.repeated_passages(none).count() == 0
