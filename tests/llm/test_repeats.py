"""Operators 3, 5 and 7 against brute force."""

import random

import numpy as np
import pytest
from brute import documents, near, removed_bytes, removed_windows, same

from voltweave.llm import bytetext as B
from voltweave.llm import neardup, recompression, suffixes


def repeated(seed, n=40, vocabulary=12):
    """Texts from few words with shared passages, runs and edits."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randint(5, 40)) for _ in range(6)] + [[words[0]] * 30]
    out = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(passages)) if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 30))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            w += part
        out.append((d * 3, rng.choice([" ", "\n", "  "]).join(w)))
    return out


def copies(seed, n=60):
    """A family of near copies around the threshold, and exact ones."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for d in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
            w[rng.randrange(len(w))] = f"u{rng.randrange(9)}"
        rows.append((d, " ".join(w[: rng.choice([120, 120, 110, 8, 5])])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_on_repeated_words(spark, seed):
    rows = repeated(seed)
    same(recompression.remove_windows(documents(spark, rows)).collect(), removed_windows(rows))


def test_windows_corner_cases(spark, corner_rows):
    got = recompression.remove_windows(documents(spark, corner_rows, extra=True).repartition(5))
    same(got.collect(), removed_windows(corner_rows))
    assert recompression.remove_windows(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        recompression.remove_windows(documents(spark, []), 16)


def test_windows_on_the_table(spark, table_rows):
    same(recompression.remove_windows(documents(spark, table_rows).repartition(7)).collect(), removed_windows(table_rows))


def test_a_common_phrase_is_dealt_out_by_its_windows():
    """One phrase in many different surroundings: no bucket gets much more than its share of the windows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from voltweave.llm import exchange as X

    texts = [" ".join([*(f"x{k}n{j}" for j in range(8)), "a", "common", "phrase", "of", "six", "words", *(f"y{k}n{j}" for j in range(8))]) for k in range(3000)]
    hits = [np.arange(10, dtype="<u4").repeat(1) << 4 | 1 for _ in texts]
    batch = pa.record_batch([pa.array(range(3000)), pa.array(range(3000)), pa.array(texts), pa.array([h.astype("<u4").tobytes() for h in hits])], names=["rid", "doc_id", "text", "hits"])
    run, fields = recompression._windows(64, 13)
    sent = pa.Table.from_batches(list(run(iter([batch]))))
    sizes = {b: len(X.arrays(sent.filter(pc.equal(sent["bucket"], b)), fields, 0)["window"]) for b in set(sent["bucket"].to_pylist())}
    assert sum(sizes.values()) == 30000 and max(sizes.values()) < 2 * 30000 / 64


def test_every_window_has_one_representative_and_equal_windows_the_same():
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{k}" for k in rng.integers(0, 9, 40))
    texts = [" ".join(f"q{k}" for k in rng.integers(0, 5, rng.integers(0, 30))) + " " + passage + " " + " ".join(f"r{k}" for k in rng.integers(0, 5, rng.integers(0, 30))) for _ in range(30)]
    import pyarrow as pa

    block = next(B.blocks(pa.record_batch([pa.array(range(30)), pa.array(texts)], names=["doc_id", "text"])))
    found = B.words(block)
    key, where, many, prints = recompression.representatives(block, found)
    each = B.ragged(where, many)
    assert sorted(each.tolist()) == B.windows(found, 13).tolist()
    of = {}
    for w, k in zip(each.tolist(), np.repeat(key, many).tolist(), strict=True):
        assert of.setdefault(int(prints[w]), k) == k


@pytest.mark.parametrize("seed", [4, 5])
def test_bytes_on_repeated_words(spark, seed):
    rows = repeated(seed, vocabulary=6)
    same(suffixes.remove_repeats(documents(spark, rows).repartition(3)).collect(), removed_bytes(rows))


def test_bytes_corner_cases(spark, corner_rows):
    same(suffixes.remove_repeats(documents(spark, corner_rows, extra=True).repartition(5)).collect(), removed_bytes(corner_rows))
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [(1, 1), (0, 0), (3, 2), (100, 4)])
def test_hot_grams_are_dealt_out(spark, hot, corner_rows):
    """A common line in different surroundings, and all else, whatever share of it is dealt out."""
    rng = random.Random(31)
    line = "this very line is common to a great many documents of the table, and what is around it differs from one to the next of them all; "
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(k, noise(rng.choice([0, 30, 150])) + line + rng.choice(["", "with a shared end that goes on for quite a while, as ends do at times, longer and longer", noise(90)]) + noise(60)) for k in range(60)]
    rows += [(100 + d, t) for d, t in repeated(9, n=25, vocabulary=6)] + [(1000 + (d or 0), t) for d, t in corner_rows]
    same(suffixes.remove_repeats(documents(spark, rows).repartition(4), hot=hot).collect(), removed_bytes(rows))


@pytest.mark.parametrize("shallow", [0, 8, 24, 64])
def test_deep_shallow_order(shallow):
    rng = np.random.default_rng(shallow)
    for _ in range(20):
        n = int(rng.integers(0, 70))
        rows = rng.integers(97, 99, (n, 40)).astype(np.uint8)
        if n > 2:
            rows[rng.integers(0, n, n // 2)] = rows[0]
            rows[rng.integers(0, n, n // 2), :20] = rows[1, :20]
        order, common = suffixes.deep_shallow(rows, shallow)
        got = [rows[k].tobytes() for k in order]
        assert got == sorted(got)
        for k in range(1, n):
            lcp = next((i for i in range(40) if got[k][i] != got[k - 1][i]), 40)
            assert common[k] == lcp


@pytest.mark.parametrize("seed", [7, 8])
def test_near_copies(spark, seed):
    rows = copies(seed)
    got = neardup.near_duplicates(documents(spark, rows).repartition(3), 3, 85, 128)
    same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), near(rows))


def test_near_corner_cases(spark, corner_rows):
    got = neardup.near_duplicates(documents(spark, corner_rows, extra=True), 3, 85, 128)
    wanted = [(d, n, d if n == 0 else c, d == (d if n == 0 else c)) for d, n, c, _ in near(corner_rows)]
    same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), wanted)
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_near_on_the_table_with_five_words(spark, table_rows):
    got = neardup.near_duplicates(documents(spark, table_rows))
    same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), near(table_rows, 5, 80))


def test_roaming_classes_of_a_bucket_come_in_chunks(spark, monkeypatch):
    n = 96
    texts = neardup.WorkTable(spark.createDataFrame([(k, f"only w{k} here and x{k // 2} there too") for k in range(n)], "node long, text string"), "t")
    wide = neardup.WorkTable(spark.createDataFrame([(1, k, k, n) for k in range(n)], "band long, node long, comp long, m long"), "w")
    monkeypatch.setattr(neardup, "CHUNK", 4)
    found = {frozenset(r) for r in neardup.links_apart(wide, texts, 1, 70).read().collect()}
    assert found == {frozenset((k, k + 1)) for k in range(0, n, 2)}

    def sizes(size, percent):
        def run(table):
            import pyarrow as pa

            return pa.table({"a": pa.array([table.num_rows], pa.int64()), "b": pa.array([0], pa.int64())})

        return run

    monkeypatch.setattr(neardup, "_apart", sizes)
    rows = [r["a"] for r in neardup.links_apart(wide, texts, 1, 70).read().collect()]
    assert len(rows) > 12 and max(rows) < n // 2


def test_star_chunks_and_leftover_components(spark, monkeypatch):
    """Small chunks: many tasks for one star, and classes that only resemble others than the centre."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rows = copies(11, 90)
    got = neardup.near_duplicates(documents(spark, rows), 3, 85, 128)
    same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), near(rows))


def test_large_stars_are_dealt_out_by_differences(spark, monkeypatch):
    """Families around the threshold whose members resemble others than the centre: edits, cuts and a second text in one star."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    monkeypatch.setattr(neardup, "DIRECT", 1)
    rng = random.Random(21)
    rows = [(200 + d, t) for d, t in copies(12, 50)]
    base = [f"t{k}" for k in range(120)]
    second = base[:60] + [f"s{k}" for k in range(60)]
    for d in range(30):
        w = list(second)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"u{rng.randrange(5)}"
        rows.append((400 + d, " ".join(w[rng.choice([0, 0, 4, 9]) :])))
    rows += [(500 + d, " ".join(base[: 60 + 2 * d])) for d in range(30)]
    found = []
    plain = neardup.buckets_of_differences
    monkeypatch.setattr(neardup, "buckets_of_differences", lambda *a: found.append(1) or plain(*a))
    got = neardup.near_duplicates(documents(spark, rows), 3, 85, 128)
    same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), near(rows))
    assert found


def test_classes_apart_give_few_links():
    """Many similar classes in components of their own: a link for each component but one, not for each pair."""
    import pyarrow as pa

    n = 120
    texts = [" ".join(["a", "b", "c"] * 3 + [f"w{j}" for j in range(100)] + [f"x{k}"]) for k in range(n)]
    table = pa.table({"node": range(n), "comp": range(n), "roam": [True] * n, "text": texts})
    assert neardup._apart(3, 85)(table).num_rows == n - 1


def test_columns_with_the_operators_own_names(spark):
    rows = documents(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words")])
    odd = rows.withColumn("_of", rows["doc_id"] + 7).withColumn("_again", rows["doc_id"] + 8).withColumn("_voltweave_of", rows["doc_id"] + 9)
    got = neardup.drop_near_duplicates(odd)
    assert got.columns == odd.columns and sorted((r["doc_id"], r["_of"], r["_again"], r["_voltweave_of"]) for r in got.collect()) == [(1, 8, 9, 10), (3, 10, 11, 12)]


def test_one_of_each_group_is_kept(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "z y x w v u"), (4, None), (5, "")]
    kept = neardup.drop_near_duplicates(documents(spark, rows))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, "a b c d e f g"), (2, "z y x w v u"), (4, ""), (5, "")]


def test_densified_bins_agree_with_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for keep, size in ((270, 300), (9, 10)):
        x, y = np.sort(a[:size]), np.sort(a[:keep])
        s = neardup.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 128, neardup.detours(128))
        assert abs((s[0] == s[1]).mean() - keep / size) < 0.12


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (5, 6), (6, 7), (30, 20), (20, 30), (8, 8)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 8), 1), 10: 10, 11: 10, 20: 20, 30: 20}
