"""Both exclusions at once: as one by one, and no match is looked for at every place that a rule names it."""

from pyspark.sql import functions as F

from driftline.functions import rules


def test_exclusions_share_their_matches(spark):
    texts = [None, "", "Le ratio est de 12,5 % au 2024-01-31", "Le ratio est de 13,1 % au 2024-04-30", "le ratio est de 12,5 %  au 2024-01-31", "Un rachat de la banque 2024-01-31", "Le calendrier du coefficient de plancher est reporté au 2024-04-30", "Le calendrier du coefficient de plancher est reporté au 2024-07-31", "Nouvelle exigence du BSIF", "Calcul selon le modèle interne 5", "Calcul selon le modèle interne 6"]
    pairs = [(a, b, k) for a in texts for b in texts for k in ("added", "modified")]
    rows = spark.createDataFrame(pairs, "source_text_t1 string, source_text_t2 string, diff_type string")
    c = {n: F.col(n) for n in rows.columns}
    both = rules.with_exclusions(rows, c)
    want = rows.withColumns({"cosmetic": rules.cosmetic_exclusion(c), "bank": rules.bank_exclusion(c)})
    assert both.columns == want.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect()))
    assert len({r["bank"] for r in both.collect()}) >= 4
    named = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert named(both) < named(want) / 2
