import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from graphtables.llm import packing, tokens
from graphtables.llm.common import written
from tests.llm import test_decontam, test_line_chunks, test_quality, test_simhash
from tests.llm.samples import bag, frame


def test_stages_by_brute_force(spark, scratch):
    """Every stage's rows against plain Python over what its predecessor kept."""
    docs, items = test_decontam.case()
    docs = [(i, t) for i, t in docs + test_line_chunks.rows() if i is not None]
    docs = [(10_000 + n, t) for n, (_, t) in enumerate(docs)] + [(9_000, "\n".join(f"word{i} thing{i} of a line" for i in range(40)))]
    items = [x for x in items if len((x[1] or "").split()) > 3]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")

    def rejected(rows):
        return [(i, t) for i, t in rows if test_quality.plain(t)[-1]]

    def deduped(rows):
        return [(i, t) for i, t, _ in test_line_chunks.plain_runs(rows)]

    def unique(rows):
        fps = {i: test_simhash.plain_fingerprint(t) for i, t in rows}
        roots, first = test_simhash.plain_components(fps.values()), {}
        for i, t in sorted(rows):
            first.setdefault(roots[fps[i]], (i, t))
        return list(first.values())

    def clean(rows):
        out = []
        for i, _, hit, _, t in test_decontam.plain(rows, items):
            spans = [m.span() for m in test_decontam.WORD.finditer(test_decontam.lowered(t))]
            cut, k = [], 0
            for w in sorted(hit):
                if w - 1 not in hit:
                    cut.append(t[k:spans[w][0]])
                k = spans[w][1]
            out.append((i, "".join([*cut, t[k:]])))
        return out

    current, rows = spark.read.parquet(f"{scratch}/documents.parquet"), docs
    columns = current.columns
    for (name, stage), expect in zip(corpus_pipeline.STAGES, (rejected, deduped, unique, clean, None)):
        current = written(stage(spark, current, scratch), "stage")
        if expect:
            before, rows = len(rows), expect(rows)
            assert current.columns == columns
            assert bag((r.doc_id, r.text, r.n_chars) for r in current.collect()) == bag((i, t, len(t)) for i, t in rows), name
    packed = current.collect()
    library = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    sizes = [(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows]
    assert bag((r.doc_id, r.start) for r in packed) == bag(
        (i, s) for i, n in sizes for s in range(0, n, max(packing.LENGTHS)))
    assert len({name for name, _ in corpus_pipeline.STAGES}) == 5
    assert corpus_pipeline.run(spark, scratch).count() == len(packed)


def test_no_documents(spark, scratch):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    assert corpus_pipeline.run(spark, scratch).collect() == []
