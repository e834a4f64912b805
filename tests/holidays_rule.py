"""US federal holidays worked out with the standard library, observed days included."""

import datetime as dt


def nth(year, month, weekday, n):
    first = dt.date(year, month, 1)
    return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def last_monday_of_may(year):
    day = dt.date(year, 5, 31)
    return day - dt.timedelta(days=day.weekday())


def expected(years):
    out = set()
    for y in years:
        fixed = [dt.date(y, 1, 1), dt.date(y, 7, 4), dt.date(y, 11, 11), dt.date(y, 12, 25)]
        out.update(fixed)
        out.update([nth(y, 1, 0, 3), nth(y, 2, 0, 3), last_monday_of_may(y), nth(y, 9, 0, 1), nth(y, 10, 0, 2), nth(y, 11, 3, 4)])
        for day in fixed:
            if day.weekday() == 5:
                out.add(day - dt.timedelta(days=1))
            if day.weekday() == 6:
                out.add(day + dt.timedelta(days=1))
    return {d for d in out if d.year in years}
