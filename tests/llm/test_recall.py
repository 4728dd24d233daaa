from spillway.llm import passages


def test_bands_miss_no_more_than_ten_of_two():
    b = passages.BANDS
    assert (1 - 0.75**b.rows) ** b.bands <= (1 - 0.75**2) ** 10
