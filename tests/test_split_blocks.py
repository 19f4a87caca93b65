"""Blocks split and told of in one numbering: the same rows as step by step, dealt fewer times."""

from lexquarry.operators import corpus as C


def test_split_blocks_equal_the_single_steps(spark):
    texts = ["TITRE 1\nArt. 1 - un\ndeux. Art. 2 - trois; Art. 3 - quatre\n\nun  deux ( x ) ;\n\nUn deux (x);", "", " ", None, "a b c d e\n\nA B C D E\n\nle b c d f g h mot xxxxx", "Art. 4 bis - x;\n- y\n\nArt. 4 bis - x;"]
    cleaned = C.clean(C.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    steps, one = C.split_articles(C.blocks(cleaned)), C.split_blocks(cleaned)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(one.select("doc_id", "block_idx", "block")) == rows(steps) and one.count() > 8
    scored = [C.scored(C.unique_blocks(C.mark_duplicates(x))) for x in (steps, one)]
    assert rows(scored[1]) == rows(scored[0])
    dealt = [C.with_hierarchy(x)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in scored]
    assert dealt[1] <= 3 < dealt[0]
