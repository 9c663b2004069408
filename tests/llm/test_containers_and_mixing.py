import random

import numpy as np
import pytest

from sparkgap.llm.container_filling import best_configuration, configuration_program, fill_containers, pack_documents, packing_report
from sparkgap.llm.source_mixing import find_quotas, mix_sources
from sparkgap.llm.token_sizes import count_tokens, load_encoding, token_sizes, tokenizer_path


def test_tokens_of_whole_texts_and_round_trip(spark):
    encoding = load_encoding(tokenizer_path())
    texts = [None, "", " \n", "a b c", "ÄÖ <|endoftext|> π", "word " * 60_000, "x" * 5_000]
    out = token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {k: count_tokens(t, encoding) for k, t in enumerate(texts)}
    for text in texts[2:]:
        assert encoding.decode(encoding.encode_ordinary(text)) == text


def test_best_configuration_is_optimal():
    rnd = random.Random(1)
    for _ in range(40):
        sizes = sorted({rnd.randint(3, 30) for _ in range(4)}, reverse=True)
        left = [rnd.randint(0, 3) for _ in sizes]
        counts = best_configuration(sizes, left, 40)
        sums = {0}
        for s, n in zip(sizes, left):
            sums = {t + k * s for t in sums for k in range(n + 1) if t + k * s <= 40}
        assert all(c <= n for c, n in zip(counts, left)) and sum(c * s for c, s in zip(counts, sizes)) == max(sums)


@pytest.mark.parametrize("seed", range(4))
def test_no_container_overflows_and_little_is_unused(seed):
    rnd = np.random.default_rng(seed)
    lengths = np.clip(rnd.lognormal(5, 1.2, 4000).astype(int), 1, 2048)
    where = fill_containers(lengths, 2048)
    sums = np.bincount(where, weights=lengths)
    assert (where >= 0).all() and sums.max() <= 2048 and (sums > 0).all()
    assert len(sums) <= np.ceil(lengths.sum() / 2048) * 1.02 + 1


def test_packing_keeps_every_token(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([0, 1, 5, 300, 2047, 2048, 2049, 9000])) for k in range(900)] + [(None, 10), (None, 10), (5, 77), (5, 77), (901, None)]
    packed = pack_documents(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), cell_items=200).collect()
    assert sum(r.n_tokens for r in packed) == sum(n or 0 for _, n in rows)
    assert all((r.container_id is None) == (r.n_tokens == 0) for r in packed)
    boxes = {}
    for r in packed:
        if r.n_tokens:
            boxes.setdefault(r.container_id, []).append((r.start, r.n_tokens))
    for spans in boxes.values():
        ends = 0
        for start, n in sorted(spans):
            assert start == ends
            ends = start + n
        assert ends <= 2048
    assert all(r.n_parts == 1 for r in packed if r.doc_id is not None and dict(rows[:900]).get(r.doc_id, 0) <= 2048)
    empty = pack_documents(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"))
    assert packing_report(empty).first().n_containers == 0


def test_quotas_take_the_largest_mix():
    quotas = find_quotas({"a": 1000, "b": 100, "c": 50}, {"a": (0.5, 1), "b": (0.4, 3), "c": (0.1, 1), "d": (0.2, 2)})
    assert quotas["c"].budget == pytest.approx(50) and quotas["a"].budget == pytest.approx(250) and quotas["b"].copies == 2 and quotas["b"].rest == pytest.approx(0)
    assert find_quotas({}, {"a": (1.0, 1)}) == {}


def test_shares_and_repeats(spark):
    rnd = random.Random(3)
    names = {"a": ["a", " A", "A "], "small": ["small"], "two words": ["Two Words", "two-words"]}
    rows = [(k, rnd.choice(names[s]), rnd.choice([0, 3, 50, 400])) for k, s in enumerate(rnd.choices(list(names), [80, 4, 16], k=4000))] + [(9001, None, 5), (9002, "other", 5)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("small", 0.2, 4), ("two_words", 0.3, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), targets)
    shares = {r.source: r for r in report.collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in shares.values())
    assert all(r.most_copies <= r.max_repeats for r in shares.values())
    got = mix.collect()
    assert sum(r.n_tokens for r in got) == sum(r.n_tokens for r in shares.values())
    assert len({(r.doc_id, r.copy_no) for r in got}) == len(got)
    none, empty = mix_sources(spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint"), targets)
    assert none.collect() == [] and {r.actual_share for r in empty.collect()} == {0.0}


def test_configuration_program_is_optimal():
    """Against the prices of brute force: no configuration is worth more than a container, and the uses meet the demand."""
    import itertools

    rnd = random.Random(7)
    for _ in range(25):
        sizes = sorted(rnd.sample(range(8, 40), 4), reverse=True)
        demand = [rnd.randint(1, 50) for _ in sizes]
        least, used = configuration_program(sizes, demand, 60)
        got = np.sum([counts * times for counts, times in used], axis=0)
        assert np.allclose(got, demand) and all(int(c @ np.array(sizes)) <= 60 for c, _ in used)
        every = [np.array(c) for c in itertools.product(*[range(60 // s + 1) for s in sizes]) if np.array(c) @ np.array(sizes) <= 60]
        # weak duality: prices under which no configuration is worth more than 1 bound the number of containers from below
        basis = np.array([c for c, _ in used], float)
        if len(used) == len(sizes):
            prices = np.linalg.solve(basis, np.ones(len(sizes)))
            assert max(c @ prices for c in every) <= 1 + 1e-6 and abs(prices @ np.array(demand) - least) < 1e-6
        assert least >= np.dot(sizes, demand) / 60 - 1e-9


def test_configurations_beat_first_fit_where_sizes_pair_up():
    lengths = np.array([1400] * 50 + [648] * 50 + [1000] * 33 + [524] * 66)
    assert len(np.bincount(fill_containers(lengths, 2048))) <= 84


def test_report_counts_what_is_beyond_the_fewest(spark):
    packed = pack_documents(spark.createDataFrame([(k, 1500) for k in range(10)], "doc_id bigint, n_tokens bigint"))
    r = packing_report(packed).first()
    assert (r.n_containers, r.fewest, r.beyond_fewest) == (10, 8, 2)


def test_a_total_and_documents_without_ids(spark):
    rows = [(None, "a", 10 + k % 7) for k in range(300)] + [(k, "b", 20) for k in range(300)]
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), targets, total_tokens=4000)
    got = {r.source: r for r in report.collect()}
    assert mix.agg({"n_tokens": "sum"}).first()[0] == sum(r.n_tokens for r in got.values()) <= 4000
    assert got["b"].n_tokens == 3000 == got["b"].budget_tokens and got["b"].unfilled_tokens == 0
    assert 0 <= got["a"].unfilled_tokens == 1000 - got["a"].n_tokens and got["a"].n_tokens > 0
