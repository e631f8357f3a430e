"""Analysis of questions on literal rows."""

from pyspark.sql import functions as F

from folioscope.functions import analysis as N


def values(spark, f, *rows):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, a string")
    return [r["x"] for r in df.select("k", f(F.col("a")).alias("x")).orderBy("k").collect()]


def test_entities(spark):
    rows = ["Does the Stalker lose line of sight in the Lost Territories?", "Can Borsuk use the AKM and a geiger counter near Viktor Reznov or the PDA", "Take ten. Players roll dice", None, ""]
    found = values(spark, N.entities, *rows)
    assert found[0] == ["CHARACTER:stalker", "LOCATION:lost territories", "MECHANIC:line of sight", "MECHANIC:los"]  # los inside lose: terms match inside words
    assert {"CHARACTER:borsuk", "WEAPON:akm", "ITEM:geiger counter", "UNKNOWN:Viktor Reznov", "UNKNOWN:PDA"} <= set(found[1]) and "WEAPON:ak" not in found[1]
    assert "WEAPON:ak" in found[2] and "CHARACTER:player" in found[2] and "ITEM:dice" in found[2]  # ak inside take
    assert found[3] == found[4] == []
    df = spark.createDataFrame([(["ITEM:card", "UNKNOWN:Bob", "ITEM:dice"],)], "a array<string>")
    assert df.select(N.by_type(F.col("a")).alias("x"), N.known_entities(F.col("a")).alias("y")).first() == ({"ITEM": ["card", "dice"], "UNKNOWN": ["Bob"]}, ["ITEM:card", "ITEM:dice"])


def test_words(spark):
    rows = ["How do players move two cards?", "Enemies attack", "Is a skill test the same as a check?"]
    assert values(spark, N.verbs, *rows) == [["move"], ["attack"], []]
    assert values(spark, N.nouns, *rows) == [["how", "player", "two", "card"], ["enemy"], ["skill", "test", "same", "check"]]
    concepts = lambda t: N.concepts(t, F.transform(N.plain_words(t), N.lemma))
    assert values(spark, concepts, *rows) == [["action", "player", "movement", "card"], ["enemy", "combat"], ["test"]]
    assert values(spark, lambda t: N.wordnet_class(t), "JJ", "VBZ", "RB", "NNS", "X") == ["a", "v", "r", "n", "n"]


def test_enhancement(spark):
    def whole(t, most=1):
        return N.enhanced(t, N.verbs(t), N.nouns(t), N.concepts(t, F.transform(N.plain_words(t), N.lemma)), most)

    rows = ["How do I move?", "how do I do it", "What is a ghost", "tell me of monsters", "nothing to add", "fight or shoot"]
    assert values(spark, whole, *rows) == ["How do I move? travel", "how do I do it action", "What is a ghost", "tell me of monsters enemy", "nothing to add", "fight or shoot attack"]
    assert values(spark, lambda t: whole(t, 3), rows[0]) == ["How do I move? travel action"]


def test_keywords(spark):
    of = lambda t: N.keywords(t, N.nouns(t))
    assert values(spark, of, "What does the window cost", "loot, loot and loot in line of sight") == [["window"], ["loot", "loot", "loot", "line", "sight"]]
    assert values(spark, N.collocations, "a b c a b d", "one two", "x y x y x y z z z z") == [["a b"], [], ["x y", "y x", "z z"]]
    assert values(spark, lambda t: N.keywords(t, F.array().cast("array<string>")), "to be or to be", "free action") == [["to be"], ["free action"]]
    terms = lambda t: N.search_terms(N.nouns(t), N.verbs(t), N.entities(t), N.concepts(t, F.transform(N.plain_words(t), N.lemma)))
    assert values(spark, terms, "Draw a card near the enemy base then move") == [["card", "near", "enemy", "draw", "move"]]


def test_lite(spark):
    got = values(spark, N.lite, "How do I move to the next space?", "What is an anomaly", "how many cards can you draw", "")
    assert [g.type for g in got] == ["how_to", "definition", "quantity", "general"] and [g.needs for g in got] == ["procedural", "definition", "quantitative", None]
    assert got[0].verbs == ["move"] and got[0].concepts == ["space"] and got[0].key_terms == ["how", "move", "next", "space"]
    assert got[0].enhanced == "How do I move to the next space? space move relocate traverse tile location"
    assert got[0].search_terms == ["space", "move", "how", "next"] and got[3].search_terms == []
