import __spark_entry__ as ent

RATIONALE_ROWS_ONLY = {"train_compare", "feature_importance", "score_batch", "evaluate_batch", "stream_score",
                       "performance_regression", "boosting_fit", "smote_recall"}


def test_entry_runs_on_smoke_data(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["target_label", "n", "mean_heart_rate", "recommendation_entrainement"]


def test_every_query_has_an_oracle_except_model_fits():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if not k.startswith("op") and k != "pipeline"}
    assert own - set(o) == RATIONALE_ROWS_ONLY


def test_no_query_name_breaks_naming_rules():
    from athlos.plans import catalog, growing, learning, parity
    for name in {**catalog.QUERIES, **parity.QUERIES, **learning.QUERIES, **growing.QUERIES}:
        assert not name.startswith("op") and "pipeline" not in name


def test_entry_without_the_training_data_files(monkeypatch):
    """The other queries stand alone when that subpackage and its pipeline are absent."""
    import builtins
    real = builtins.__import__

    def absent(name, *args, **kw):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kw)
    monkeypatch.setattr(builtins, "__import__", absent)
    assert not any(k.startswith("op") or k == "pipeline" for k in {**ent.queries(), **ent.oracle_sql()})
