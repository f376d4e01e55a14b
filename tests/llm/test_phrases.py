"""Boilerplate phrases inside prose."""

import duckdb
import pytest

import corpus_pipeline
from caseloom.llm import oracle, queries, quality


def test_phrases_in_prose_leave_documents_alone(spark):
    prose = " ".join(f"word{k}" for k in range(60))
    line = f"We believe in design in schools, and people who read more {prose} write better."
    twice = "Sign up, sign in, read more, click here, log in to, follow us on, share this, privacy policy, terms of use."
    rows = [(0, line), (1, "\n".join([line, "Read more.", "All rights reserved.", twice])), (2, f"{prose}.\nThe design in use is good.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, df.selectExpr("*", "0L as n_chars"), "").collect()}
    assert out == {0: line, 1: line, 2: rows[2][1]}


@pytest.mark.parametrize("line", ["Tous droits réservés, 2024.", "TODOS LOS DERECHOS RESERVADOS!", "Hier klicken und weiterlesen.", "Mehr in der Datenschutzerklärung.", "Leer más, SÍGUENOS."])
def test_phrases_of_other_languages_go(spark, line):
    prose = " ".join(f"wort{k}" for k in range(60)) + "."
    df = spark.createDataFrame([(0, f"{prose}\n{line}")], "doc_id long, text string")
    assert quality.quality_rules(df).first().clean_text == prose


def test_phrases_agree_with_sql(spark, tmp_path):
    prose = " ".join(f"wort{k}" for k in range(60))
    lines = ["Sign in.", "Désign in.", "Sign inside.", "ſign in.", "Ésign in: sign in", "read more read more", f"{prose} read more", "SIGN UP, sign up; Sign Up. sign up! sign up and we go on with some more of it.", "Leer Más.", "aller au contenu.", "(click here)", "see x.click here.y"]
    rows = [(k, f"{line}\n{prose}." if k % 2 else f"{line}\n{line} no sentence at the end of these many words here") for k, line in enumerate(lines)]
    rows += [(100 + k, "\n".join([line] * 30) + f"\n{prose}") for k, line in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracle.OP8).df()
    got = queries.op8_quality_rules(spark, str(tmp_path)).toPandas()[list(want.columns)]
    key = lambda d: sorted(map(tuple, d.astype(str).to_numpy().tolist()))
    assert key(got) == key(want)
