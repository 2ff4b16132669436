"""The stemmer against pairs from its published sample vocabulary and description."""

import pytest

from ragmill.functions import stem
from ragmill.operators import search

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife
knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
caresses caress ponies poni ties tie cats cat gas gas this this agreed agre plastered plaster motoring motor hopping hop hoping hope
luxuriated luxuri cry cri by by say say generate generat general general communism communism skies sky dying die news news
relational relat conditional condit hopefulness hope controll control rate rate happy happi""".split()


@pytest.mark.parametrize(("word", "wanted"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_stems(word, wanted):
    assert stem.stem(word) == wanted


def test_stemmed_search(spark):
    chunks = spark.createDataFrame([(1, "the consigned goods are hoping"), (2, "consistent hope"), (3, "goods")], "id long, content string")
    found = search.lexical_topk(chunks, stem.query_lexemes("The hopes of consignment"), 5, stem.english_lexeme).collect()
    assert [r.id for r in found] == [1]
    assert stem.query_lexemes("the of and") == []
