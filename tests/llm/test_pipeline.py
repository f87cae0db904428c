"""The pipeline, stage by stage, against plain versions of its decisions."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import brute, fixtures
from wavepanel.llm import toxicity
from wavepanel.llm.common import read_table, write_shared


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = write_shared(stage(spark, docs, SF_SMALL), "test-stage")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii",
                                                      "bpe encoding and decoding"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_stage(spark, stages):
    model = toxicity.fit(stages[0], read_table(spark, SF_SMALL, "labels"))
    scores = rows(toxicity.score(stages[0], model))
    assert rows(stages[1]).keys() == {i for i, r in scores.items() if r.score < 0.5}


def test_near_duplicate_stage(stages):
    before = sorted(rows(stages[1]).items())
    roots = brute.linked([brute.fingerprint(r.text or "") for _, r in before], 3)
    assert set(rows(stages[2])) == {before[r][0] for r in set(roots)}


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    kept = rows(stages[3])
    for i, r in rows(stages[2]).items():
        whole = [b for _, b in items if " ".join(brute.leak_words(b)) in " ".join(brute.leak_words(r.text or ""))]
        grams = set(re.findall(r"\w+", (r.text or "").lower()))
        if whole:
            assert i not in kept
        elif not any(len(grams & set(brute.leak_words(b))) >= 10 for _, b in items):
            assert i in kept


def test_pii_stage(stages):
    after = rows(stages[4])
    assert after.keys() == rows(stages[3]).keys()
    for i, r in rows(stages[3]).items():
        found = brute.base_pii(r.text or "")
        if not found:
            continue
        assert not brute.base_pii(after[i].text) and after[i].n_chars == len(after[i].text)
        assert after[i].text.count("<EMAIL>") >= (sum(k == "email" for k, _, _ in found) > 0)


def test_token_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = rows(stages[5])
    assert out.keys() == rows(stages[4]).keys()
    for i, r in rows(stages[4]).items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(out[i].ids) == brute.u32(ids) and out[i].decoded_sha256 == brute.sha((r.text or "").encode())


def test_awkward_documents_pass_all_stages(spark):
    for docs in (fixtures.documents(spark), fixtures.empty(spark)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns
            docs = write_shared(out, "test-awkward")
        assert (docs.count() > 0) == (n > 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert set(entry.oracle_sql()) <= names
