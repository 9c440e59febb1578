"""Operators in several threads of one session: none deletes what another has written."""

from concurrent.futures import ThreadPoolExecutor

from quire.llm import queries

SF = "/root/testdata/sf0.001"


def test_four_operators_at_once_are_as_one_after_the_other(spark):
    names = ["op3_simhash_bktree", "op6_byte_shards", "op3_simhash_bktree", "op8_hilbert_neighbours"]
    run = lambda name: sorted(map(tuple, queries.queries()[name](spark, SF).collect()), key=repr)
    alone = {name: run(name) for name in set(names)}
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, names)) == [alone[name] for name in names]
