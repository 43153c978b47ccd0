"""A catalog and ready-made audiences for mobile lines and their owners.

Tables: ``customer`` (with ``city``), ``subscription`` (with ``customer_id``, ``plan_id``,
``tac``), ``plan``, ``device``, ``addon``, ``has_addon(src, dst)``, ``usage`` (with
``msisdn``), ``city``, ``ticket`` (with ``customer_id``), ``calls(src, dst, calls, minutes)``
and ``linked_to(src, dst, link_type, source)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from muster.model import Anchor, Attribute, Catalog, Entity, Hop, Kpi, Metric, Network
from muster.operators.conditions import (
    Condition,
    all_of,
    any_of,
    attribute,
    edge,
    metric,
    network,
    related,
)
from muster.sources.tables import as_of_date

# Names, allowed texts and bucket edges a saved rule may refer to.
SUBSCRIPTION = (
    Attribute("msisdn"),
    Attribute("payment_type", "enum", values=("PREPAID", "POSTPAID")),
    Attribute("status", "enum", values=("ACTIVE", "SUSPENDED", "CHURNED")),
    Attribute("activation_date", "date"),
    Attribute("tenure_months", "number", buckets=(6, 12, 24, 48, 96)),
    Attribute("arpu_3m", "number", buckets=(25, 50, 100, 200, 350)),
    Attribute("churn_score", "number", buckets=(0.2, 0.4, 0.6, 0.8)),
    Attribute("last_recharge_date", "date"),
    Attribute("nps", "number", buckets=(7, 9)),
    Attribute("influence_score", "number", buckets=(50, 75, 90, 97)),
    Attribute("community_id", "number"),
    Attribute("community_size", "number", buckets=(5, 10, 20, 40)),
    Attribute("community_churn_rate", "number", buckets=(0.05, 0.1, 0.2, 0.3)),
)
CUSTOMER = (
    Attribute("customer_id"),
    Attribute("full_name"),
    Attribute("gender", "enum", values=("M", "F")),
    Attribute("age", "number", buckets=(18, 25, 35, 45, 55, 65)),
    Attribute("nationality_group", "enum", values=("Local", "Expat")),
    Attribute("value_tier", "enum", values=("Platinum", "Gold", "Silver", "Bronze")),
    Attribute("credit_class", "enum", values=("A", "B", "C", "D")),
    Attribute("tenure_months", "number", buckets=(12, 36, 60, 120)),
    Attribute("digital_app_user", "boolean"),
    Attribute("household_size", "number", buckets=(2, 3, 4)),
    Attribute("preferred_language", "enum", values=("Arabic", "English")),
)
PLAN = (
    Attribute("name"),
    Attribute("category", "enum", values=(
        "Prepaid Basic", "Prepaid Data", "Postpaid Core", "Postpaid Unlimited", "Youth")),
    Attribute("monthly_fee", "number", buckets=(50, 100, 200, 300)),
    Attribute("data_allowance_gb", "number"),
    Attribute("is_unlimited", "boolean"),
)
DEVICE = (
    Attribute("brand"),
    Attribute("model"),
    Attribute("os", "enum", values=("iOS", "Android", "Other")),
    Attribute("is_5g", "boolean"),
    Attribute("price_tier", "enum", values=("Low", "Mid", "High", "Premium")),
    Attribute("release_year", "number", buckets=(2019, 2021, 2023)),
)
ADDON = (
    Attribute("name"),
    Attribute("category", "enum", values=(
        "Roaming", "Data", "Entertainment", "International Calls", "Social")),
    Attribute("price", "number"),
)
USAGE = (
    Attribute("month", "date"),
    *(Attribute(n, "number") for n in ("data_mb", "voice_min", "sms_count", "roaming_mb", "intl_min",
                                       "revenue", "recharge_count")),
)
CITY = (
    Attribute("name"),
    Attribute("region", "enum", values=("Central", "Western", "Eastern", "Northern", "Southern")),
)
TICKET = (
    Attribute("category", "enum", values=("Billing", "Network", "Device", "Plan Change", "Other")),
    Attribute("status", "enum", values=("OPEN", "RESOLVED")),
    Attribute("severity", "enum", values=("Low", "Medium", "High")),
    Attribute("opened_at", "date"),
)
LINK_TYPES = ("Household", "Family", "Corporate", "Same person")
HOUSEHOLD_LINK_TYPES = ("Household", "Family")
# What is shown first when a node has many neighbours, and what names a node.
PRIORITY = {"LINKED_TO": 0, "OWNS": 1, "ON_PLAN": 2, "USES_DEVICE": 3, "LIVES_IN": 4,
            "HAS_ADDON": 5, "RAISED": 6, "CALLED": 7}
CAPTIONS = ("full_name", "name", "model", "msisdn", "category", "month")


def catalog(t: Mapping[str, DataFrame]) -> Catalog:
    owned = Hop("subscription", "customer_id", "customer_id", many=True)
    owner = Hop("customer", "customer_id", "customer_id")
    plan = Hop("plan", "plan_id", "plan_id")
    device = Hop("device", "tac", "tac")
    holds = Hop("has_addon", "msisdn", "src", many=True)
    addon = Hop("addon", "dst", "addon_id")
    used = Hop("usage", "msisdn", "msisdn", many=True)
    city = Hop("city", "city", "name")
    raised = Hop("ticket", "customer_id", "customer_id", many=True)

    def below_line(*hops: Hop) -> dict[str, tuple[Hop, ...]]:
        return {"subscription": hops, "customer": (owned, *hops)}

    def below_customer(*hops: Hop) -> dict[str, tuple[Hop, ...]]:
        return {"subscription": (owner, *hops), "customer": hops}

    entities = (
        Entity("subscription", "subscription", "msisdn", SUBSCRIPTION, below_line()),
        Entity("customer", "customer", "customer_id", CUSTOMER, below_customer()),
        Entity("plan", "plan", "plan_id", PLAN, below_line(plan)),
        Entity("device", "device", "tac", DEVICE, below_line(device)),
        Entity("addon", "addon", "addon_id", ADDON, below_line(holds, addon)),
        Entity("usage", "usage", "usage_id", USAGE, below_line(used)),
        Entity("city", "city", "name", CITY, below_customer(city)),
        Entity("ticket", "ticket", "ticket_id", TICKET, below_customer(raised)),
    )

    def usage(name: str, aggregate: str, column: str, months: int = 3) -> Metric:
        return Metric(name, "usage", aggregate, column, "month", months)

    metrics = (
        usage("avg_data_mb", "avg", "data_mb"),
        usage("total_data_mb", "sum", "data_mb"),
        usage("avg_voice_min", "avg", "voice_min"),
        usage("total_roaming_mb", "sum", "roaming_mb", 6),
        usage("total_intl_min", "sum", "intl_min"),
        usage("total_revenue", "sum", "revenue"),
        usage("avg_revenue", "avg", "revenue"),
        usage("total_recharges", "sum", "recharge_count"),
        usage("max_data_mb", "max", "data_mb"),
        Metric("ticket_count", "ticket", "count", "", "opened_at", 6),
        Metric("line_count", "subscription", "count"),
        Metric("addon_count", "addon", "count"),
    )
    networks = (
        Network("calls", "subscription", "calls",
                (Attribute("calls", "number"), Attribute("minutes", "number"))),
        Network("account_links", "customer", "linked_to",
                (Attribute("link_type", "enum", values=LINK_TYPES),)),
    )
    # What is shown of each anchor.
    anchors = (
        Anchor("subscription",
               profile=("subscription.payment_type", "subscription.status", "plan.category",
                        "device.brand", "device.is_5g", "customer.value_tier", "customer.age",
                        "customer.nationality_group", "city.region", "subscription.tenure_months",
                        "subscription.influence_score", "subscription.community_churn_rate"),
               kpis=(Kpi("arpu", field="subscription.arpu_3m"),
                     Kpi("churn", field="subscription.churn_score"),
                     Kpi("community_churn", field="subscription.community_churn_rate"),
                     Kpi("data", metric="avg_data_mb", window_months=3),
                     Kpi("voice", metric="avg_voice_min", window_months=3),
                     Kpi("roaming", metric="total_roaming_mb", window_months=6)),
               sample=("subscription.msisdn", "subscription.payment_type", "plan.name",
                       "device.model", "subscription.arpu_3m", "subscription.churn_score")),
        Anchor("customer",
               profile=("customer.value_tier", "customer.age", "customer.gender",
                        "customer.nationality_group", "customer.credit_class", "city.region",
                        "customer.digital_app_user", "customer.household_size"),
               kpis=(Kpi("lines", metric="line_count"),
                     Kpi("revenue", metric="total_revenue", window_months=3),
                     Kpi("tickets", metric="ticket_count", window_months=6)),
               sample=("customer.customer_id", "customer.full_name", "customer.value_tier",
                       "customer.age", "city.name")),
    )
    return Catalog(t, entities, anchors, metrics, networks,
                   clock=lambda: as_of_date(t["usage"], "month"), link_network="account_links")


ACTIVE = attribute("subscription.status", "eq", "ACTIVE")
CHURNED = attribute("subscription.status", "eq", "CHURNED")

# The ready-made audiences with their thresholds, as (anchor, rule).
AUDIENCES: dict[str, tuple[str, Condition]] = {
    "high_value_at_risk": ("subscription", all_of(
        attribute("subscription.payment_type", "eq", "POSTPAID"), ACTIVE,
        attribute("subscription.arpu_3m", "gte", 200),
        attribute("subscription.churn_score", "gte", 0.6))),
    "churn_contagion": ("subscription", all_of(
        ACTIVE, network("calls", CHURNED, (edge("calls", "gte", 5),), "gte", 2))),
    "social_influencers": ("subscription", all_of(ACTIVE, network("calls", op="gte", n=20))),
    "five_g_upsell": ("subscription", all_of(
        ACTIVE, attribute("device.is_5g", "eq", True), attribute("plan.is_unlimited", "eq", False),
        metric("avg_data_mb", "gt", 15000, 3))),
    "prepaid_to_postpaid": ("subscription", all_of(
        attribute("subscription.payment_type", "eq", "PREPAID"), ACTIVE,
        metric("avg_revenue", "gte", 70, 3), metric("avg_data_mb", "gte", 10000, 3),
        attribute("customer.credit_class", "in", ["A", "B"]))),
    "travelers_without_roaming": ("subscription", all_of(
        metric("total_roaming_mb", "gt", 500, 6),
        ~related("addon", attribute("addon.category", "eq", "Roaming")))),
    "expat_international": ("subscription", all_of(
        attribute("customer.nationality_group", "eq", "Expat"),
        metric("total_intl_min", "gte", 150, 3),
        ~related("addon", attribute("addon.category", "eq", "International Calls")))),
    "device_upgrade": ("subscription", all_of(
        ACTIVE, attribute("customer.value_tier", "in", ["Platinum", "Gold"]),
        attribute("device.release_year", "lte", 2020))),
    "network_detractors": ("subscription", any_of(
        related("ticket", all_of(attribute("ticket.category", "eq", "Network"),
                                 attribute("ticket.opened_at", "within_last_days", 90)), "gte", 2),
        attribute("subscription.nps", "lte", 4))),
    "youth_digital": ("customer", all_of(
        attribute("customer.age", "between", [18, 25]),
        attribute("customer.digital_app_user", "eq", True))),
    "multi_line_families": ("customer", all_of(related("subscription", ACTIVE, "gte", 3))),
    "household_churn_risk": ("customer", network(
        "account_links", related("subscription", CHURNED),
        (edge("link_type", "in", list(HOUSEHOLD_LINK_TYPES)),))),
    "influencers_in_churning_communities": ("subscription", all_of(
        ACTIVE, attribute("subscription.influence_score", "gte", 90),
        attribute("subscription.community_churn_rate", "gte", 0.15))),
    "household_fmc": ("customer", all_of(
        attribute("customer.household_size", "gte", 3), related("subscription", ACTIVE))),
}
