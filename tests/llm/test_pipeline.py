import os
import subprocess
import sys

import pytest
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as P
    from pergamo.llm.bpe_codec import word_tokenizer
    from tests.llm.test_dedup import joined, slow_fingerprint, slow_lines

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "bpe_codec"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from pergamo.session import settle

    kept = settle(P.STAGES[0][1](spark, docs, SMALL))
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()
    lined = settle(P.STAGES[1][1](spark, kept, SMALL))
    before = sorted(kept.collect(), key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in lined.collect()}
    want = slow_lines([r.text for r in before])
    assert lined.columns == docs.columns and len(after) == len(before)
    assert sum(after[r.doc_id].text == w for r, w in zip(before, want)) >= 0.98 * len(want)
    one = settle(P.STAGES[2][1](spark, lined, SMALL))
    ids = sorted(after)
    fps = [slow_fingerprint(after[i].text) for i in ids]
    comp = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert sorted(r.doc_id for r in one.collect()) == [ids[c] for c in sorted(set(comp))]
    mixed = settle(P.STAGES[3][1](spark, one, SMALL))
    assert mixed.columns == docs.columns and mixed.join(one, "doc_id", "left_anti").count() == 0
    library = Tokenizer.from_file(word_tokenizer())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = P.STAGES[4][1](spark, mixed, SMALL).collect()
    assert len(out) == mixed.count()
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert P.run(spark, SMALL).count() == len(out)


def test_last_stage_decodes(spark, make):
    import hashlib

    import corpus_pipeline as P
    from pergamo.llm.bpe_codec import word_tokenizer

    library = Tokenizer.from_file(word_tokenizer())
    texts = ["The cat's  hat\nand I'll", "", None, "漢字 😀 x", "I'll <|endoftext|> go", "naïve " * 50]
    out = P.STAGES[-1][1](spark, make(texts), "")
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    for r in out.collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_stages_on_edges(spark, edge):
    import corpus_pipeline as P

    docs = edge
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == edge.columns
    none = edge.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


@pytest.mark.parametrize("what", ["pergamo.llm", "corpus_pipeline"])
def test_entry_without(what):
    """The entry module imports where the subpackage or the pipeline is missing."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {what!r} or name.startswith({what!r} + '.'):
            raise ModuleNotFoundError(name, name={what!r})
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and 'bm25_topk' in e.queries()
assert ('op1_token_counts' in e.queries()) == ({what!r} != 'pergamo.llm')
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
