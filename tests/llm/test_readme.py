from pathlib import Path

from spillway.llm import lm


def test_readme_states_the_prior_of_op7():
    row = next(x for x in (Path(__file__).parents[2] / "README.md").read_text().splitlines() if x.startswith("| `op7_lm_scores` | log"))
    assert f"prior {lm.Settings().prior:g} " in row
