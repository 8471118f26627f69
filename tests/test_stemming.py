"""Published words and stems of the English stemmer."""

import pytest
from pyspark.sql import functions as F

from fathomgrid.functions.stemming import stem_word, stems

PAIRS = """consigned consign consigning consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori
consolidating consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc
knackeries knackeri knavish knavish kneading knead kneeled kneel knees knee knightly knight knitted knit knives knive knocker knocker knocks knock
generate generat general general generic generic generous generous communication communic community communiti arsenal arsenal hopping hop hoping hope
luxuriated luxuri ties tie cries cri gas gas this this gaps gap kiwis kiwi by by say say cry cri relational relat rational ration hopefully hope conditional condit
sensibility sensibl adjustment adjust adoption adopt bed bed shed shed shred shred youth youth boyish boyish fly fli flying fli syzygy syzygi sayyid sayyid analogies analog
valuable valuabl probate probat controlling control falling fall happy happi agreed agre feed feed employs employ electricity electr skies sky dying die news news
inning inning proceed proceed exceeding exceed formalize formal triplicate triplic goodness good national nation formative format operator oper decisiveness decis
caresses caress ponies poni plastered plaster motoring motor sized size troubled troubl fizzed fizz filing file sky sky radically radic vileness vile geology geolog apology apolog""".split()


@pytest.mark.parametrize("word, stem", zip(PAIRS[::2], PAIRS[1::2], strict=True))
def test_published_stems(word, stem):
    assert stem_word(word) == stem


def test_column(spark):
    rows = spark.createDataFrame([("flies",), (None,), ("",), ("42nds",)], "w string").select(stems(F.col("w"))).collect()
    assert [r[0] for r in rows] == ["fli", None, "", "42nds"]
