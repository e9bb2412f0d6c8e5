import numpy as np
import pytest

from lexisieve.llm import toxicity

LEXICON = {"vile": 0, "rotte*": 1}
LOUD = toxicity.LEXICONS + 2
CALM = "A calm sentence about the weather of the day and of the week. " * 200
SHOUT = "YOU ARE A VILE AND ROTTEN LOT! "


@pytest.mark.parametrize("calm", [CALM, CALM.replace(".", ""), CALM.replace(". ", "\n")])
def test_place_and_length_do_not_matter(calm):
    front, back, middle = (toxicity.signals(t, LEXICON) for t in (SHOUT + calm, calm + SHOUT, calm + SHOUT + calm))
    assert front[LOUD] == 1 and front == back == middle


def test_only_shouting_around_a_hit_counts():
    quiet = ["A vile lot. " + "THIS IS LOUD. ", "vile", "A calm vile day of the USA", "ALL LOUD AND CLEAN", "", "Vile words. " * 2000]
    assert [toxicity.signals(t, LEXICON)[LOUD] for t in quiet] == [0.0] * len(quiet)
    assert toxicity.signals("ÄÖÜ VILE", LEXICON)[LOUD] == 1


def test_a_late_shouted_passage_is_flagged():
    weights = np.zeros(toxicity.LEXICONS + 5)
    weights[LOUD] = 4.0
    score = lambda text: 1 / (1 + np.exp(2.0 - np.array(toxicity.signals(text, LEXICON)) @ weights))
    assert score(SHOUT + CALM) == score(CALM + SHOUT) > 0.7 > score(CALM)
