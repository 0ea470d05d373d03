from collections import defaultdict

import numpy as np
import public_tokenizers

from personae.llm import packing


def check(rows, lengths, sizes):
    """Every token of every row in exactly one place, bins sound and as short as possible."""
    covered, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        covered[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append((r.bin_offset, r.length, r.bin_size))
    for key, n in lengths.items():
        parts = sorted(covered[key])
        assert sum(x for _, x in parts) == n
        assert [s for s, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
    for held in bins.values():
        used, at = sum(x for _, x, _ in held), 0
        size = {s for _, _, s in held}
        assert size == {min(s for s in sizes if s >= used)}
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
    return bins


def test_all_tokens_are_placed(spark):
    rng = np.random.default_rng(1)
    lengths = {i: int(x) for i, x in enumerate(rng.lognormal(4, 1.3, 800))}
    lengths |= {900: 0, 901: 64, 902: 65, 903: 128, 904: 1000, 905: 128}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long")
    sizes = (32, 64, 128)
    rows = packing.pack(df, lengths=sizes, group=300).collect()
    bins = check(rows, lengths, sizes)
    assert len({b.split("-")[0] for b in bins}) > 1
    held = sum(lengths.values()) / sum(b[0][2] for b in bins.values())
    assert held > 0.9


def test_best_fit_takes_the_tightest_room():
    packer = packing.Packer([100], np.bincount([60, 50, 45, 40], minlength=101))
    assert [packer.place(n)[0] for n in (60, 50, 45, 40)] == [0, 1, 1, 0]
    assert packer.downsized() == [100, 100]


def test_the_cheapest_size_is_opened():
    # only pieces of 60: a bin of 64 wastes least; 100 would stay 40 short
    packer = packing.Packer([64, 100], np.bincount([60] * 5, minlength=101), overhead=4)
    for _ in range(5):
        packer.place(60)
    assert [c for c, _ in packer.bins] == [64] * 5
    # pieces of 30 fill a bin of 64 with 60, one of 128 with 120: overhead decides for it
    packer = packing.Packer([64, 128], np.bincount([30] * 8, minlength=129), overhead=16)
    packer.place(30)
    assert packer.bins[0][0] == 128


def test_defined_cases(spark):
    df = spark.createDataFrame(
        [(None, None), (1, ""), (1, ""), (2, " "), (3, "word " * 9000)], "doc_id long, text string"
    )
    counts = packing.token_counts(df, public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(counts).collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in rows) == [
        (0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 8192), (3, 8192, 808),
    ]
    assert packing.pack(counts.limit(0)).count() == 0
