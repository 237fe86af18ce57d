"""The registered queries on the smallest tables: against their SQL, or against a plain version where there is none."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import license, queries, toxicity  # noqa: A004

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}')")
    return con


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else round(float(v), 6) if isinstance(v, (bool, int, float, np.generic)) else v
    return sorted(map(repr, ([plain(v) for v in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if c == "removed_lines":
            got[c], want[c] = got[c].map(lambda x: str(list(map(int, x)))), want[c].map(lambda x: str(list(map(int, x))))
        if c == "score":  # sums of products in another order
            got[c], want[c] = got[c].round(9), want[c].round(9)
    assert len(got) and rows(got) == rows(want)


def test_op1_gives_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op1_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op6_scores_as_a_plain_version_and_holds_out(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(150).collect():
        words = sorted(set(re.findall("[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))))
        raw = sum(model.w[f] for f in {int(f) for w in words for f in toxicity.features_of(pa.array([w]))[1]})
        want = sum(1 / (1 + np.exp(t - raw)) for t in model.t) if words else 0
        assert abs(got[r.doc_id].expected_severity - want) < 1e-6 and got[r.doc_id].rejected == (got[r.doc_id].expected_severity >= model.cut)
    held = [(r.toxic, got[r.doc_id].rejected) for r in labels.where("doc_id % 2 = 1 and toxic is not null").collect() if r.doc_id in got]
    toxic, clean = [x for t, x in held if t], [x for t, x in held if not t]
    assert np.mean(clean) < 0.02, np.mean(clean)
    assert np.mean(toxic) > 0.8, np.mean(toxic)


def test_op10_finds_every_line_that_says_so(spark):
    """Every line that holds a whole template is found, and every finding agrees with its template as words and pairs say."""
    texts = {r.doc_id: (r.text or "").split("\n") for r in queries.table(spark, SF, "documents").collect()}
    found = queries.op10_license(spark, SF).collect()
    plain = lambda x: re.sub("[^a-z0-9\u0080-\U0010ffff]+", " ", x.lower()).strip()
    whole = {(i, k) for i, ls in texts.items() for k, x in enumerate(ls) for ts in license.TEMPLATES.values() for t in ts if len(t.split()) > 4 and plain(t) == plain(x)}
    assert whole <= {(r.doc_id, r.line) for r in found}
    for r in found:
        assert "\n".join(texts[r.doc_id])[0:] and r.paragraph.split("\n")[0] == texts[r.doc_id][r.line]
        sets = [set(w) | set(zip(w, w[1:], strict=False)) for w in (plain(r.paragraph).split(), plain(r.template).split())]
        assert abs(len(sets[0] & sets[1]) / len(sets[1]) - r.agreement) < 0.35 and r.agreement >= 0.6
