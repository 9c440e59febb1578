"""The pipeline, stage by stage against plain versions, and its queries."""

import hashlib

import corpus_pipeline as C
from quire.llm import decontaminate, pseudonyms, quality, queries
from quire.llm.shared import table, tables_written

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    machine = quality.fitted(docs, table(spark, SF, "labels"))
    columns, before = docs.columns, docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns
        rows = {r.doc_id: r.text for r in before.collect()}
        own = {r.doc_id: r.text for r in after.collect()}
        if name == "quality":
            keep = {r.doc_id for r in quality.scored(before, machine).filter("predicted = 1").collect()}
            assert own == {d: t for d, t in rows.items() if d in keep} and 0 < len(own) < len(rows)
        if name == "near-duplicates":
            sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in rows.items() for w in [t.lower().split()]}
            best = {d: d for d in sets}
            for _ in sets:  # the smallest id reachable, by rounds
                new = {a: min(best[b] for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) for a in sets}
                if new == best:
                    break
                best = new
            assert set(own) == {d for d in best if best[d] == d}
        if name == "decontamination":
            dirty = {r.doc_id for r in decontaminate.report(before, table(spark, SF, "benchmark")).filter("contaminated").collect()}
            assert set(own) == set(rows) - dirty
        if name == "pseudonyms":
            rewrite = pseudonyms.rewriter(pseudonyms.session_key(spark, demonstration=True))
            assert own == {d: rewrite(t)[0] for d, t in rows.items()}
        before = spark.createDataFrame(after.collect(), after.schema)
    got = C.STAGES[-1][1](spark, before, SF).collect()
    assert len(got) == 2 * before.count() and all(r.round_trip for r in got)
    mark = tables_written()
    run = C.run(spark, SF).select("doc_id", "rank", "ids_xxh64").collect()
    assert tables_written() == mark + 1  # only the last stage's rows are left
    assert sorted(map(tuple, run)) == sorted((r.doc_id, r.rank, r.ids_xxh64) for r in got)


def test_queries_give_the_contracts_columns(spark):
    first = {
        "op1_wrapper_text": ["page_id", "url", "text", "n_chars"], "op2_byte_language": ["doc_id", "held_out", "lang_pred", "score"], "op3_simhash_bktree": ["doc_id", "fingerprint", "component_id"],
        "op4_quality_machine": ["doc_id", "held_out", "score", "predicted"], "op6_byte_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op8_hilbert_neighbours": ["query_id", "rank", "vec_id", "score"],
        "op10_suffix_matches": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    }
    for name, f in queries.queries().items():
        rows = f(spark, SF).collect()
        assert rows
        if name in first:
            assert rows[0].__fields__ == first[name]
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in queries.op10_suffix_matches(spark, SF).collect()}
