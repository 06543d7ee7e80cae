"""Own CSV exports with the published totals: rows are made from the figures
(so many staff of a role, so many leavers of a tenure band, of a month, of a
reason, of a manager's team) by rule, so that the tests of published figures
run where the exports themselves are not mounted."""

import csv
import datetime as dt
import itertools

# The published figures.
RATE_BY_ROLE = {"Driver": (64, 40, 62.5), "Front Desk": (24, 12, 50.0), "Mover": (63, 31, 49.2),
                "Dispatcher": (16, 6, 37.5), "Manager": (18, 4, 22.2)}
EXITS_BY_BAND = {"1-2 years": 41, "6-12 months": 18, "2-3 years": 16, "3-6 months": 11, "0-3 months": 6, "3+ years": 1}
EXIT_REASONS = {"Burnout": 24, "Involuntary - No Show": 19, "Personal Reasons": 17, "Involuntary - Performance": 16,
                "Better Pay": 9, "Found Other Work": 5, "Relocated": 3}
EXITS_BY_MONTH = [18, 21, 2, 20, 2, 4, 2, 6, 4, 2, 9, 3]
STOCK_STATUS = {"OK": 74, "Overstocked": 30, "Low Stock": 16}
TWO_YEAR_EXPENSES = {"S001": 284722, "S002": 245837, "S003": 332045}
WORST_MANAGER, WORST_TEAM = 35, (7, 6, 2)  # staff, exits, burnout exits
CLASHES = 9                                # leavers by their own will with an involuntary reason

_BAND_DAYS = {"0-3 months": 60, "3-6 months": 120, "6-12 months": 250, "1-2 years": 500, "2-3 years": 900, "3+ years": 1300}
# staff and exits of the 18 teams: 8 high, 6 to watch, 4 healthy
_TEAMS = [WORST_TEAM[:2]] + [(10, 7)] * 7 + [(10, 5)] * 6 + [(8, 1)] * 2 + [(7, 1)] * 2


def _write(folder, name, rows):
    path = folder / name
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    return str(path)


def _spread(counts):
    return list(itertools.chain.from_iterable([k] * n for k, n in counts))


def _people():
    """(role, manager, leaves) of all 185: teams first, then the managers."""
    managers = [WORST_MANAGER, *range(1, 18)]
    roles = {True: _spread((r, x) for r, (_, x, _) in RATE_BY_ROLE.items() if r != "Manager"),
             False: _spread((r, n - x) for r, (n, x, _) in RATE_BY_ROLE.items() if r != "Manager")}
    for manager, (n, gone) in zip(managers, _TEAMS, strict=True):
        for k in range(n):
            yield roles[k < gone].pop(), manager, k < gone
    total, gone, _ = RATE_BY_ROLE["Manager"]
    for k in range(total):
        yield "Manager", None, k >= total - gone


def hr_exports(folder):
    people = list(_people())
    ids = itertools.chain((i for i in itertools.count(100)))
    managers = iter([WORST_MANAGER, *range(1, 18)])
    bands = _spread(EXITS_BY_BAND.items())
    months = _spread((m, n) for m, n in enumerate(EXITS_BY_MONTH, 1))
    burnt = WORST_TEAM[2]
    others = [r for r in _spread(EXIT_REASONS.items()) if r != "Burnout"]
    burnouts = EXIT_REASONS["Burnout"]
    clashes, employees, exits, reviews = CLASHES, [], [], []
    for role, manager, leaves in people:
        who = next(managers) if role == "Manager" else next(ids)
        row = {"employee_id": who, "name": f"Person {who}", "role": role, "department": "Operations", "hire_date": "2024-02-01", "termination_date": "",
               "termination_type": "", "hourly_rate": 20, "manager_id": f"{manager}.0" if manager else "", "status": "Active"}
        if leaves:
            last = dt.date(2025, months.pop(), 15)
            if manager == WORST_MANAGER:
                burnt, reason = burnt - 1, "Burnout" if burnt > 0 else others.pop()
            else:
                spare = burnouts - WORST_TEAM[2] - sum(1 for x in exits if x["exit_reason"] == "Burnout" and x["manager_id"] != f"{WORST_MANAGER}.0")
                reason = "Burnout" if spare > 0 else others.pop()
            involuntary = reason.startswith("Involuntary")
            clash = involuntary and clashes > 0
            clashes -= clash
            row |= {"hire_date": last - dt.timedelta(days=_BAND_DAYS[bands.pop()]), "termination_date": last, "status": "Terminated",
                    "termination_type": "Involuntary" if involuntary and not clash else "Voluntary"}
            exits.append({"employee_id": who, "exit_date": last, "exit_reason": reason, "exit_survey_score": 3, "eligible_for_rehire": "Yes",
                          "manager_id": row["manager_id"]})
        employees.append(row)
        reviews.append({"employee_id": who, "review_period": "2025-H1", "score": 3.5, "promoted": "False", "manager_notes_tag": "Reliable"})
    return _write(folder, "staff_export.csv", employees), _write(folder, "exit_export.csv", exits), _write(folder, "review_export.csv", reviews)


def retail_exports(folder):
    shop = {"store_name": "", "borough": "", "owner": ""}
    stock = []
    for k, status in enumerate(_spread(STOCK_STATUS.items())):
        units = {"OK": 80, "Overstocked": 180, "Low Stock": 5}[status]
        stock.append({"store_id": f"S00{k % 3 + 1}", **shop, "category": "Snacks", "product": f"Thing {k}", "units_in_stock": units, "reorder_threshold": 20,
                      "unit_cost": "1.25", "stock_value": f"{units * 1.25:.2f}", "status": status})
    expenses = []
    for store, total in TWO_YEAR_EXPENSES.items():
        for k in range(24):
            labor = total // 24 - 1000 + (total % 24 if k == 23 else 0)
            expenses.append({"store_id": store, **shop, "year": 2024 + k // 12, "month": k % 12 + 1, "month_name": "", "rent": 600, "labor": labor,
                             "utilities": 300, "misc_expenses": 100, "total_expenses": labor + 1000})
    return _write(folder, "stock_export.csv", stock), _write(folder, "expense_export.csv", expenses)


def restaurant_exports(folder):
    menu = [{"item_id": f"M{k}", "category": ("Pasta", "Wine", "Bar")[k % 3], "item": f"Piatto {k} à la carte", "price": f"{10 + k}.00",
             "cogs_pct": f"0.{20 + k}", "gross_margin_pct": 80 - k, "is_alcohol": k % 3 > 0, "launch_year": 2020} for k in range(33)]
    staff = [{"employee_id": f"E{k}", "name": f"Zoë {k}", "role": "Server", "base_hourly_rate": "15.50", "hire_date": "2021-05-01"} for k in range(14)]
    return _write(folder, "menu_export.csv", menu), _write(folder, "staff_dim_export.csv", staff)
