from collections import defaultdict

import pytest

from paperloom.llm.packing import PackingOptions, _Windows, pack, packing_report, token_counter

PATH = "/opt/tokenizers/"


def check(rows, sizes, n):
    boxes = defaultdict(list)
    for r in rows:
        boxes[r.profile, r.container].append(r)
    for (profile, _), items in boxes.items():
        items.sort(key=lambda r: r.place)
        assert [r.place for r in items] == list(range(len(items)))
        at = 0
        for r in items:
            assert r.offset == at
            at += r.n_tokens
        assert at <= sizes[profile]
    texts = defaultdict(list)
    for r in rows:
        texts[r.profile, r.k].append(r)
    assert len(texts) == n * len(sizes)
    for (profile, _), pieces in texts.items():
        pieces.sort(key=lambda r: r.piece)
        total = sum(r.n_tokens for r in pieces)
        assert len(pieces) == max(1, -(-total // sizes[profile]))
        assert [r.first_token for r in pieces] == [i * sizes[profile] for i in range(len(pieces))]


@pytest.mark.parametrize("windows,group", [(64, 20_000), (2, 20_000), (4, 3)])
def test_everything_has_one_place(spark, windows, group):
    texts = [f"word {'again ' * (i * 7 % 90)}" for i in range(400)] + [None, "", "   "] + ["many words " * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k bigint, t string, container int").repartition(3)
    sizes = {"a": 100, "b": 37}
    profiles = spark.createDataFrame([*sizes.items(), ("none", None), ("zero", 0)], "profile string, capacity int")
    packed = pack(df, "k", "t", profiles, PackingOptions(windows=windows, merge_group=group))
    rows = packed.collect()
    check(rows, sizes, len(texts))
    report = {r.profile: r for r in packing_report(packed, profiles).collect()}
    assert report["a"].filled > (0.9 if windows > 2 else 0.8) and report["a"].containers >= report["a"].least_containers


def test_empty(spark):
    df = spark.createDataFrame([], "k bigint, t string")
    profiles = spark.createDataFrame([("a", 10)], "profile string, capacity int")
    assert pack(df, "k", "t", profiles).count() == 0
    some = spark.createDataFrame([(1, "x")], "k bigint, t string")
    assert pack(some, "k", "t", profiles.limit(0)).count() == 0


def test_best_fit_and_the_fullest_is_emitted():
    w = _Windows(10, 2, 0)
    assert w.place(6) == (0, 0, 0) and w.place(7) == (1, 0, 0)
    assert w.place(3) == (1, 1, 7)  # fills container 1
    assert w.place(5) == (2, 0, 0) and w.place(5) == (2, 1, 5)
    assert w.place(9)[0] == 3 and w.place(8)[0] == 4  # container 3 was the fullest and is closed
    assert w.place(4) == (0, 1, 6)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokenizers(name):
    with open(PATH + name, "rb") as f:
        count = token_counter(name, f.read())
    assert count(["", "hello world <|endoftext|>"])[0] == 0 and count(["hello world"])[0] >= 2


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        token_counter("x.bin", b"")


def test_every_profile_of_a_large_table(spark):
    texts = spark.createDataFrame([(1, "a few words"), (2, "and some more")], "k bigint, t string")
    sizes = spark.createDataFrame([(f"p{i:04}", 100 + i) for i in range(1100)], "profile string, capacity int")
    assert pack(texts, "k", "t", sizes).select("profile").distinct().count() == 1100
