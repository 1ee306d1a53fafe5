import datetime as dt

from tillroll.functions import windows as w

D = dt.date


def test_trailing_year_is_one_year_and_a_day():
    t = w.trailing_year(D(2024, 3, 15))
    assert t == w.Window(D(2023, 2, 28), D(2024, 2, 29))
    assert w.prior_trailing_year(D(2024, 3, 15)) == w.Window(D(2022, 2, 28), D(2023, 2, 28))


def test_leap_day_clamps_like_add_months():
    assert w.add_years(D(2024, 2, 29), -1) == D(2023, 2, 28)
    assert w.add_years(D(2023, 2, 28), 1) == D(2024, 2, 28)


def test_calendar_windows():
    assert w.previous_calendar_year(D(2001, 7, 15)) == w.Window(D(2000, 1, 1), D(2000, 12, 31))
    assert w.calendar_years_back(D(2001, 7, 15)) == w.Window(D(1998, 1, 1), D(2000, 12, 31))
    assert w.year_to_date(D(2001, 1, 1)).end < w.year_to_date(D(2001, 1, 1)).start  # empty on Jan 1
    assert w.year_to_yesterday(D(2001, 1, 1)) == w.Window(D(2000, 1, 1), D(2000, 12, 31))
    assert len(w.dates_between(w.last_days(D(2000, 7, 15), 16))) == 17


def test_kpi_months_two_months_last_cut_at_yesterday():
    assert w.kpi_months(D(2001, 7, 15)) == [
        w.Window(D(2001, 6, 1), D(2001, 6, 30)),
        w.Window(D(2001, 7, 1), D(2001, 7, 14)),
    ]
    # On the 1st, yesterday is the last day of the previous month.
    assert w.kpi_months(D(2001, 7, 1)) == [
        w.Window(D(2001, 5, 1), D(2001, 5, 31)),
        w.Window(D(2001, 6, 1), D(2001, 6, 30)),
    ]
