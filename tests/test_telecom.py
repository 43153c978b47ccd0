"""The ready-made audiences and every kind of condition against a plain recount."""

import random
from datetime import date, timedelta

import pytest

from muster.operators.conditions import (
    AttributeIs,
    Group,
    MetricIs,
    NetworkCount,
    RelatedCount,
    all_of,
    any_of,
    attribute,
    edge,
    metric,
    network,
    related,
)
from muster.model import COUNT_OPERATORS, METRIC_OPERATORS, OPERATORS
from muster.operators.evaluate import flags, matching
from muster.plans import telecom

AS_OF = date(2026, 3, 1)
A = attribute


def make_rows():
    pick = random.Random(7)
    rows = {n: [] for n in ("customer", "subscription", "plan", "device", "addon", "has_addon", "usage",
                            "city", "ticket", "calls", "linked_to")}
    cities = ["Riyadh", "Jeddah", "Dammam"]
    rows["city"] = [dict(name=c, region=r) for c, r in zip(cities, ("Central", "Western", "Eastern"))]
    rows["plan"] = [dict(plan_id=f"P{i}", name=n, category=c, monthly_fee=f, data_allowance_gb=g, is_unlimited=u)
                    for i, (n, c, f, g, u) in enumerate([
                        ("Prepaid 10", "Prepaid Basic", 30, 5, False), ("Postpaid Max", "Postpaid Unlimited", 300, 0, True),
                        ("postpaid core", "Postpaid Core", 150, 50, False)])]
    rows["device"] = [dict(tac=f"T{i}", brand=b, model=m, os=o, is_5g=g, price_tier=p, release_year=y)
                      for i, (b, m, o, g, p, y) in enumerate([
                          ("Sam", "Galaxy S9", "Android", False, "Mid", 2018), ("App", "Phone 14 Pro", "iOS", True, "Premium", 2022),
                          ("Sam", "Galaxy S23", "Android", True, "High", 2023)])]
    rows["addon"] = [dict(addon_id=f"A{i}", name=c, category=c, price=10 * i)
                     for i, c in enumerate(["Roaming", "Data", "International Calls"])]
    for i in range(60):
        rows["customer"].append(dict(
            customer_id=f"C{i:03d}", full_name=f"Name {i}", gender=pick.choice("MF"), age=pick.randint(15, 70),
            nationality_group=pick.choice(["Local", "Expat"]), credit_class=pick.choice("ABCD"),
            value_tier=pick.choice(["Platinum", "Gold", "Silver", "Bronze"]), tenure_months=pick.randint(0, 99),
            digital_app_user=pick.random() < .6, household_size=pick.randint(1, 4),
            preferred_language="Arabic", city=pick.choice(cities)))
        for j in range(pick.choice([0, 1, 1, 2, 4])):
            line = f"9665{i:03d}{j}"
            rows["subscription"].append(dict(
                msisdn=line, customer_id=f"C{i:03d}", plan_id=f"P{pick.randrange(3)}", tac=f"T{pick.randrange(3)}",
                payment_type=pick.choice(["PREPAID", "POSTPAID"]),
                status=pick.choice(["ACTIVE", "ACTIVE", "ACTIVE", "SUSPENDED", "CHURNED"]),
                activation_date=date(2023, 6, 1) + timedelta(pick.randrange(900)), tenure_months=pick.randint(0, 90),
                arpu_3m=pick.uniform(10, 400), churn_score=pick.random(), nps=pick.randint(0, 10),
                last_recharge_date=None if pick.random() < .3 else AS_OF - timedelta(pick.randrange(60)),
                influence_score=pick.randint(60, 100), community_id=1, community_size=5,
                community_churn_rate=round(pick.random() / 2, 3)))
            for addon in pick.sample(range(3), pick.choice([0, 0, 1, 2])):
                rows["has_addon"].append(dict(src=line, dst=f"A{addon}"))
            for m in range(6):
                if pick.random() < .7:
                    month = date(2025 + (9 + m) // 12, (9 + m) % 12 + 1, 1)
                    rows["usage"].append(dict(
                        usage_id=f"{line}-{m}", msisdn=line, month=month, data_mb=pick.randint(0, 30000),
                        voice_min=pick.randint(0, 500), sms_count=1, roaming_mb=pick.choice([0, 0, 400]),
                        intl_min=pick.randint(0, 120), revenue=pick.uniform(20, 200), recharge_count=1))
        for j in range(pick.choice([0, 0, 1, 3])):
            rows["ticket"].append(dict(
                ticket_id=f"K{i}-{j}", customer_id=f"C{i:03d}", category=pick.choice(["Network", "Network", "Billing"]),
                status="OPEN", severity="Low", opened_at=AS_OF + timedelta(pick.randint(-150, 10))))
    lines = [s["msisdn"] for s in rows["subscription"]]
    for pair in sorted({tuple(pick.sample(lines, 2)) for _ in range(400)}) + [(lines[0], lines[0])]:
        rows["calls"].append(dict(src=pair[0], dst=pair[1], calls=pick.randint(1, 12), minutes=pick.randint(1, 500)))
    people = [c["customer_id"] for c in rows["customer"]]
    seen = {tuple(sorted(pick.sample(people, 2))) for _ in range(60)}
    for a, b in sorted(seen):
        rows["linked_to"].append(dict(src=a, dst=b, link_type=pick.choice(telecom.LINK_TYPES), source="data"))
    return rows


ROWS = make_rows()
LABEL = {"subscription": "msisdn", "customer": "customer_id"}


@pytest.fixture(scope="module")
def catalog(spark):
    def column_type(values):
        value = next(v for v in values if v is not None)
        return {str: "string", bool: "boolean", int: "long", float: "double", date: "date"}[type(value)]

    tables = {}
    for name, rows in ROWS.items():
        schema = ", ".join(f"{c} {column_type([r[c] for r in rows])}" for c in rows[0])
        tables[name] = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return telecom.catalog(tables)


# ---- the plain recount: rows in lists, one anchor at a time ------------------------------
def reach(anchor, row, entity):
    """Related rows as a bag, one per path."""
    path = {"customer": {"subscription": ["own"]}, "subscription": {}}[anchor].get(entity)
    if entity == anchor:
        return [row]
    lines = [s for s in ROWS["subscription"] if s["customer_id"] == row["customer_id"]]
    if anchor == "customer" and entity in ("plan", "device", "addon", "usage"):
        return [x for s in lines for x in reach("subscription", s, entity)]
    if path:
        return lines
    find = lambda table, key, value: [x for x in ROWS[table] if x[key] == value]
    if entity in ("plan", "device"):
        key = {"plan": "plan_id", "device": "tac"}[entity]
        return find(entity, key, row[key])
    if entity == "addon":
        return [a for h in find("has_addon", "src", row["msisdn"]) for a in find("addon", "addon_id", h["dst"])]
    if entity == "usage":
        return find("usage", "msisdn", row["msisdn"])
    owner = find("customer", "customer_id", row["customer_id"])
    if entity == "customer":
        return owner
    if entity == "city":
        return [c for o in owner for c in find("city", "name", o["city"])]
    return [k for o in owner for k in find("ticket", "customer_id", o["customer_id"])]


def test_value(x, op, v):
    if op == "is_null":
        return x is None
    if op == "is_not_null":
        return x is not None
    if x is None:
        return None
    if isinstance(x, date) and op not in ("within_last_days", "before_last_days"):
        v = [date.fromisoformat(i) for i in v] if isinstance(v, list) else date.fromisoformat(v)
    return {
        "eq": lambda: x == v, "neq": lambda: x != v, "gt": lambda: x > v, "gte": lambda: x >= v,
        "lt": lambda: x < v, "lte": lambda: x <= v, "between": lambda: v[0] <= x <= v[1],
        "in": lambda: x in v, "not_in": lambda: x not in v,
        "contains": lambda: v.lower() in x.lower(), "starts_with": lambda: x.lower().startswith(v.lower()),
        "ends_with": lambda: x.lower().endswith(v.lower()),
        "within_last_days": lambda: AS_OF - timedelta(v) <= x <= AS_OF,
        "before_last_days": lambda: x < AS_OF - timedelta(v),
    }[op]()


test_value.__test__ = False


def months_before(n):
    at = AS_OF.year * 12 + AS_OF.month - 1 - n
    return date(at // 12, at % 12 + 1, 1)


def holds(rule, anchor, row, own=None):
    if isinstance(rule, Group):
        parts = [holds(c, anchor, row, own) for c in rule.children]
        if rule.op == "and":
            made = False if False in parts else None if None in parts else True
        else:
            made = True if True in parts or not parts else None if None in parts else False
    elif isinstance(rule, AttributeIs):
        entity, name = rule.field.split(".")
        if entity == (own or anchor):
            made = test_value(row[name], rule.op, rule.value)
        else:
            made = any(test_value(x[name], rule.op, rule.value) is True for x in reach(anchor, row, entity))
    elif isinstance(rule, MetricIs):
        m = next(m for m in telecom_metrics if m.name == rule.metric)
        found = reach(anchor, row, m.entity)
        if m.time_column:
            low = months_before(rule.window_months or m.window_months)
            found = [x for x in found if low < x[m.time_column] <= AS_OF]
        values = [x.get(m.column) for x in found]
        value = 0 if not found else {"sum": sum, "min": min, "max": max, "count": len,
                                     "avg": lambda v: sum(v) / len(v)}[m.aggregate](values)
        made = test_value(value, rule.op, rule.value)
    elif isinstance(rule, RelatedCount):
        found = {id(x) for x in reach(anchor, row, rule.entity)
                 if rule.where is None or holds(rule.where, anchor, x, rule.entity) is True}
        made = test_value(len(found), rule.op, rule.n)
    elif isinstance(rule, NetworkCount):
        table, key = {"calls": "calls", "account_links": "linked_to"}[rule.network], LABEL[anchor]
        near = set()
        for e in ROWS[table]:
            for a, b in ((e["src"], e["dst"]), (e["dst"], e["src"])):
                if a == row[key] and all(test_value(e[t.attribute], t.op, t.value) for t in rule.edge_where):
                    near.add(b)
        by_key = {x[key]: x for x in ROWS[anchor]}
        kept = [n for n in near if rule.where is None or holds(rule.where, anchor, by_key[n]) is True]
        made = test_value(len(kept), rule.op, rule.n)
    return None if made is None else (not made if rule.negated else made)


telecom_metrics = telecom.catalog({}).metrics

PROBED = {"number": ("customer", "customer.age"), "string": ("subscription", "device.brand"),
          "enum": ("subscription", "customer.value_tier"), "boolean": ("subscription", "device.is_5g"),
          "date": ("customer", "usage.month")}


def quartiles(entity, column):
    """Values that split the rows of a table into four, as a rule would write them."""
    found = sorted(x[column] for x in ROWS[entity] if x[column] is not None)
    return [str(v) if isinstance(v, date) else v for v in (found[len(found) * k // 4] for k in (1, 2, 3))]


def operator_cases():
    """Every operator of every attribute type, with values drawn from the rows."""
    for kind, (anchor, name) in PROBED.items():
        low, middle, high = quartiles(*name.split("."))
        shaped = {"between": [low, high], "in": [low, high], "not_in": [middle], "is_null": None, "is_not_null": None,
                  "within_last_days": 70, "before_last_days": 45}
        shaped |= {"contains": str(middle)[1:3].upper(), "starts_with": str(low)[:2], "ends_with": str(high)[-2:].upper()}
        for op in sorted(OPERATORS[kind]):
            rule = A(name, op, shaped.get(op, middle))
            yield f"{kind} {op}", (anchor, rule)
            yield f"not {kind} {op}", (anchor, ~rule)


def metric_cases():
    """Every metric from every anchor that reaches it, the operators in turn."""
    ops = sorted(METRIC_OPERATORS)
    for k, m in enumerate(telecom_metrics):
        low, _, high = quartiles(m.entity, m.column) if m.column else (1, 2, 3)
        for j, anchor in enumerate(("subscription", "customer")):
            if (m.entity, anchor) == ("subscription", "subscription"):
                continue
            op = ops[(k + 3 * j) % len(ops)]
            months = [None, 1, 12][(k + j) % 3] if m.time_column else None
            yield f"{m.name} of {anchor}", (anchor, metric(m.name, op, [low, high] if op == "between" else low, months))


def count_cases():
    """Related rows of every entity, and both networks, the count operators in turn."""
    ops = sorted(COUNT_OPERATORS)
    filters = {"addon": A("addon.category", "in", ["Data", "Social"]), "usage": A("usage.data_mb", "gt", quartiles("usage", "data_mb")[1]),
               "ticket": any_of(A("ticket.severity", "eq", "High"), ~A("ticket.status", "eq", "OPEN"))}
    for anchor in ("subscription", "customer"):
        for k, entity in enumerate(sorted({"addon", "city", "customer", "device", "plan", "subscription", "ticket", "usage"} - {anchor})):
            for n in range(3):
                op = ops[(k + 2 * n) % len(ops)]
                yield f"{anchor}: {entity} {op} {n}", (anchor, related(entity, filters.get(entity) if n else None, op, n))
    calls, links = (lambda *a, **b: network("calls", *a, **b)), (lambda *a, **b: network("account_links", *a, **b))
    busy = quartiles("calls", "calls")[2]
    for n, op in enumerate(ops):
        yield f"calls {op} {n}", ("subscription", calls(A("device.is_5g", "eq", n % 2 == 0), op=op, n=n))
        yield f"busy calls {op} {n}", ("subscription", calls(edge_where=(edge("calls", "gte", busy),), op=op, n=n))
        yield f"links {op} {n}", ("customer", links(related("ticket"), (edge("link_type", "neq", "Family"),), op, n))
    yield "calls to callers", ("subscription", calls(calls(metric("total_revenue", "gt", 0), op="gt", n=2), n=2))


def batches(size=11):
    """Cases of one kind and anchor together: one pass answers them all."""
    for make in (operator_cases, metric_cases, count_cases):
        cases = list(make())
        for anchor in ("subscription", "customer"):
            own = [(name, rule) for name, (at, rule) in cases if at == anchor]
            for k in range(0, len(own), size):
                yield pytest.param(anchor, dict(own[k:k + size]), id=f"{make.__name__} {anchor} {k}")


@pytest.mark.parametrize("anchor, rules", batches())
def test_cases_equal_recount(catalog, anchor, rules):
    for r in flags(catalog, anchor, rules, AS_OF).collect():
        row = next(x for x in ROWS[anchor] if x[LABEL[anchor]] == r[0])
        assert r.asDict() == {LABEL[anchor]: r[0], **{n: holds(rule, anchor, row) is True for n, rule in rules.items()}}


@pytest.mark.parametrize("name", telecom.AUDIENCES)
def test_audience_equals_recount(catalog, name):
    anchor, rule = telecom.AUDIENCES[name]
    got = sorted(r[0] for r in matching(catalog, anchor, rule, AS_OF).collect())
    expected = sorted(r[LABEL[anchor]] for r in ROWS[anchor] if holds(rule, anchor, r) is True)
    assert got == expected


def test_profiles_of_both_anchors(catalog):
    from muster.operators import insights
    for anchor in ("subscription", "customer"):
        found = insights.profile(catalog, anchor, all_of(), as_of=AS_OF)
        size = found.counts.first()
        assert size.segment_size == size.base_size == len(ROWS[anchor])
        assert all(r.lift == pytest.approx(1) for r in found.kpis.collect() if r.lift is not None)
        assert {r["index"] for r in found.dimensions.collect()} == {100}
