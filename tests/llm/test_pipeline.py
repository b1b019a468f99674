import corpus_pipeline
from skein.llm import bpe, decontaminate
from skein.llm.common import table
from test_spans import brute


def five_words(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_and_their_columns(spark, sf):
    """Each stage on what the one before kept, held against what its operator does by brute force."""
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_spans", "decontamination", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
    all_docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    clean = [d for d, r in all_docs.items() if any(c.isalpha() for c in r.text)]
    assert len(kept["language"]) >= 0.97 * len(clean)
    # Near-duplicates: five-word shingles of Jaccard similarity 0.8 or more, by comparing all pairs of texts.
    sets = {d: five_words(r.text) for d, r in kept["language"].items()}
    group = {d: d for d in sets}
    for a, b in sorted((min(a, b), max(a, b)) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
        least, most = sorted((group[a], group[b]))
        group = {d: least if g == most else g for d, g in group.items()}
    assert set(kept["near_duplicates"]) == {d for d, g in group.items() if d == g} != set(sets)
    texts = {d: r.text for d, r in kept["near_duplicates"].items()}
    cut = brute(texts.items())
    assert {d: (r.text, r.n_chars) for d, r in kept["repeated_spans"].items()} == {d: (x, len(x)) for d, x in cut.items() if x.strip() or x == texts[d]}
    items = decontaminate.Items([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()], decontaminate.MIN_MATCH)
    for d, r in kept["repeated_spans"].items():
        leak = any(2 * covered >= n for _, n, covered, _ in items.scan(r.text))
        assert (d in kept["decontamination"]) == (not leak)
    own = bpe.load(bpe.word_bpe())
    assert {d: r.ids for d, r in kept["bpe"].items()} == {d: " ".join(map(str, own.encode(r.text))) for d, r in kept["decontamination"].items()}


def test_empty_and_odd_tables(spark, odd_docs, make_docs, tmp_path):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "long words here long words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {None, 5, 6, 7}
