"""SQL twins of the registered queries, for an independent engine over the same tables.

Each query is a body over named common table expressions; only those a body needs, directly or
through others, are put in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tidemark.schemas import RAW_TABLES, RELATIONAL_TABLES

_B = "00000000-0000-5000-8000-00000000000"


def _stg(table: str, key: str) -> str:
    return (
        f"select * exclude (rn) from (select *, row_number() over (partition by {key} "
        f"order by source_updated_at desc, batch_id desc, record_hash desc) as rn from raw_{table}) "
        "where rn = 1 and not is_deleted"
    )


def _row_text(**columns: str) -> str:
    """Length-prefixed values in column order; ``-`` for NULL. Timestamps count microseconds."""
    parts = []
    for name, kind in sorted(columns.items()):
        text = f"epoch_us({name})::varchar" if kind == "ts" else f"{name}::varchar"
        parts.append(f"coalesce(length({text})::varchar || ':' || {text}, '-')")
    return " || ".join(parts)


def _slice(digest: str, index: int = 0) -> str:
    return f"cast(cast('0x' || substr({digest}, {1 + 15 * index}, 15) as bigint) as decimal(38,0))"


def _checksum(digest: str, where: str = "") -> str:
    """The sums of all slices of a digest as text."""
    sums = (f"cast(sum({_slice(digest, i)}) {where} as decimal(38,0))::varchar" for i in range(5))
    return f"concat_ws('-', {', '.join(sums)})"


def _digest(table: str, source: str, text: str) -> str:
    sums = ", ".join(f"cast(sum({_slice('h', i)}) as decimal(38,0)) as digest_{i}" for i in range(5))
    return (
        f"select '{table}' as table_name, count(*) as row_count, {sums} "
        f"from (select sha256({text}) as h from {source})"
    )


def _content(table: str) -> str:
    """Row count and digest sums of the business columns of a raw table, times in milliseconds as loading keeps them."""
    kinds = {f.name: "ts" if isinstance(f.dataType, T.TimestampType) else "other" for f in RAW_TABLES[table].business.fields}
    times = ", ".join(f"date_trunc('milliseconds', {name}) as {name}" for name, kind in kinds.items() if kind == "ts")
    return _digest(table, f"(select * replace ({times}) from raw_{table})", _row_text(**kinds))


def _live_keys(second: str) -> str:
    """Live keys of the six relational tables; ``second`` settles revisions of equal source time."""
    return " union all ".join(
        f"select '{table}' as table_name, {KEYS[table]} as key from raw_{table} group by {KEYS[table]} "
        f"having not arg_max(is_deleted, row(source_updated_at, {second}, record_hash))" for table in RELATIONAL_TABLES)


_REVENUE_TEXT = _row_text(
    grain_key="text", order_date="date", currency="text", paid_orders="number", gross_order_value="number",
    captured_revenue="number", refunded_revenue="number", net_revenue="number",
)

KEYS = {
    "customers": "customer_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "payments": "payment_id",
    "refunds": "refund_id",
    "events": "event_id",
    "marketing_campaigns": "campaign_id",
    "campaign_spend": "spend_id",
    "product_catalog": "product_id",
}


def _revised(number: str, rows: str) -> str:
    """The rows with an earlier revision for every sixth key, as the raw views have it."""
    older = "(_earlier and _n % 12 <> 0)"
    return f"""
        select * exclude (_n, _earlier) replace (
          case when {older} then updated_at - interval 1 day else updated_at end as updated_at,
          case when {older} then source_updated_at - interval 1 day else source_updated_at end as source_updated_at,
          case when {older} then ingested_at - interval 1 day else ingested_at end as ingested_at,
          case when _earlier then {older} and _n % 18 = 0 else is_deleted end as is_deleted,
          case when {older} then '{_B}0' else batch_id end as batch_id,
          case when _earlier then sha256(record_hash || '|earlier') else record_hash end as record_hash)
        from ({rows.replace("        from ", f", {number} as _n from ", 1)})
        join (values (true), (false)) as revisions(_earlier) on not _earlier or _n % 6 = 0"""


CTES: dict[str, str] = {
    "raw_customers": f"""
        select 'cus_' || c_custkey::varchar as customer_id,
               lower(c_name) || '-r' || r::varchar || '@example.test' as email,
               case when c_custkey % 10 <> 0 then n_name end as country,
               timestamp '1995-01-01' as created_at,
               cast(date '1995-01-01' + (case when c_custkey % 7 = 0 then 1 else r end) as timestamp) as updated_at,
               (r = 3) as is_deleted,
               '{_B}' || r::varchar as batch_id,
               cast(date '1995-01-01' + (case when c_custkey % 7 = 0 then 1 else r end) as timestamp) as source_updated_at,
               cast(date '1995-01-01' + (case when c_custkey % 7 = 0 then 1 else r end) as timestamp)
                 + interval 1 hour as ingested_at,
               sha256(c_custkey::varchar || '|' || r::varchar) as record_hash
        from customer join nation on c_nationkey = n_nationkey
        join (values (1), (2), (3)) as revisions(r)
          on r = 1 or (r = 2 and c_custkey % 5 = 0) or (r = 3 and c_custkey % 11 = 0)""",
    "raw_orders": _revised("o_orderkey", f"""
        select 'ord_' || o_orderkey::varchar as order_id, 'cus_' || o_custkey::varchar as customer_id,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'cancelled' end as status,
               case o_orderkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'VND' end as currency,
               cast(o_orderdate as timestamp) as ordered_at, cast(o_orderdate as timestamp) as updated_at,
               false as is_deleted, '{_B}1' as batch_id, cast(o_orderdate as timestamp) as source_updated_at,
               cast(o_orderdate as timestamp) + interval 1 hour as ingested_at,
               sha256(o_orderkey::varchar) as record_hash
        from orders"""),
    "raw_order_items": _revised("l_orderkey", f"""
        select 'item_' || l_orderkey::varchar || '-' || l_linenumber::varchar as order_item_id,
               'ord_' || l_orderkey::varchar as order_id, 'prod_' || l_partkey::varchar as product_id,
               cast(l_quantity as integer) as quantity, cast(l_extendedprice as decimal(18,2)) as unit_price,
               cast(l_shipdate as timestamp) as updated_at, false as is_deleted, '{_B}1' as batch_id,
               cast(l_shipdate as timestamp) as source_updated_at,
               cast(l_shipdate as timestamp) + interval 1 hour as ingested_at,
               sha256(l_partkey::varchar || '|' || l_suppkey::varchar || '|'
                 || cast(l_extendedprice as decimal(18,2))::varchar) as record_hash
        from lineitem"""),
    "raw_payments": _revised("o_orderkey", f"""
        select 'pay_' || o_orderkey::varchar as payment_id, 'ord_' || o_orderkey::varchar as order_id,
               'txn_' || o_orderkey::varchar as provider_transaction_id,
               case when o_orderkey % 10 = 0 then 'failed' else 'succeeded' end as status,
               cast(o_totalprice as decimal(18,2)) as amount,
               case when o_orderkey % 10 <> 0 then cast(o_orderdate as timestamp) end as succeeded_at,
               cast(o_orderdate as timestamp) as updated_at, false as is_deleted, '{_B}1' as batch_id,
               cast(o_orderdate as timestamp) as source_updated_at,
               cast(o_orderdate as timestamp) + interval 1 hour as ingested_at,
               sha256(o_orderkey::varchar) as record_hash
        from orders where o_orderkey % 17 <> 0"""),
    "raw_refunds": _revised("o_orderkey", f"""
        select 'ref_' || o_orderkey::varchar as refund_id, 'pay_' || o_orderkey::varchar as payment_id,
               case when o_orderkey % 12 = 0 then 'failed' else 'succeeded' end as status,
               cast(100 + o_orderkey % 400 as decimal(18,2)) as amount,
               case when o_orderkey % 12 <> 0 then cast(o_orderdate as timestamp) end as succeeded_at,
               cast(o_orderdate as timestamp) as updated_at, false as is_deleted, '{_B}1' as batch_id,
               cast(o_orderdate as timestamp) as source_updated_at,
               cast(o_orderdate as timestamp) + interval 1 hour as ingested_at,
               sha256(o_orderkey::varchar) as record_hash
        from orders where o_orderkey % 4 = 0 and o_orderkey % 10 <> 0 and o_orderkey % 17 <> 0"""),
    "raw_events": _revised("event_id", f"""
        select 'evt_' || event_id::varchar as event_id,
               case event_type when 'view' then 'product_viewed' when 'click' then 'add_to_cart'
                 when 'purchase' then 'checkout_completed' else event_type end as event_type,
               'sess_' || user_id::varchar || '_' || cast(ts as date)::varchar as session_id,
               case when user_id % 6 <> 0 then 'cus_' || user_id::varchar end as customer_id,
               case when event_id % 5 <> 0 then 'prod_' || (event_id % 200)::varchar end as product_id,
               case when event_id % 10 <> 0 then 'cmp_' || (user_id % 30)::varchar end as campaign_id,
               cast(ts as timestamp) as occurred_at, cast(ts as timestamp) as updated_at,
               (event_id % 97 = 0) as is_deleted, '{_B}1' as batch_id, cast(ts as timestamp) as source_updated_at,
               cast(ts as timestamp) + interval 1 hour as ingested_at, sha256(event_id::varchar) as record_hash
        from events"""),
    "raw_marketing_campaigns": _revised("n_nationkey", f"""
        select 'cmp_' || n_nationkey::varchar as campaign_id, n_name as name,
               case when n_nationkey % 2 = 0 then 'search' else 'social' end as channel,
               timestamp '2024-01-01' as starts_at,
               case when n_nationkey % 2 = 0 then timestamp '2024-02-01' end as ends_at,
               timestamp '2024-01-01' as updated_at, false as is_deleted, '{_B}1' as batch_id,
               timestamp '2024-01-01' as source_updated_at, timestamp '2024-01-01 01:00:00' as ingested_at,
               sha256(n_name) as record_hash
        from nation"""),
    "raw_campaign_spend": _revised("s_suppkey", f"""
        select 'spend_' || s_suppkey::varchar as spend_id, 'cmp_' || (s_suppkey % 28)::varchar as campaign_id,
               date '2024-01-01' + cast(s_suppkey % 40 as integer) as spend_date,
               cast(s_acctbal as decimal(18,2)) as amount, timestamp '2024-01-01' as updated_at,
               false as is_deleted, '{_B}1' as batch_id, timestamp '2024-01-01' as source_updated_at,
               timestamp '2024-01-01 01:00:00' as ingested_at, sha256(s_name) as record_hash
        from supplier"""),
    "raw_product_catalog": _revised("p_partkey", f"""
        select 'prod_' || p_partkey::varchar as product_id, p_name as product_name, p_type as category,
               case when p_partkey % 10 <> 0 then cast(p_retailprice as decimal(18,2)) end as unit_cost,
               timestamp '1995-01-01' as updated_at, false as is_deleted, '{_B}1' as batch_id,
               timestamp '1995-01-01' as source_updated_at, timestamp '1995-01-01 01:00:00' as ingested_at,
               sha256(p_partkey::varchar) as record_hash
        from part"""),
    **{f"stg_{table}": _stg(table, key) for table, key in KEYS.items()},
    "order_gross": """
        select order_id, cast(sum(quantity * unit_price) as decimal(38,2)) as gross_amount
        from stg_order_items group by order_id""",
    "order_paid": """
        select order_id,
               cast(sum(case when status = 'succeeded' then amount else 0 end) as decimal(38,2)) as paid_amount
        from stg_payments group by order_id""",
    "refunds_by_order": """
        select p.order_id,
               cast(sum(case when r.status = 'succeeded' then r.amount else 0 end) as decimal(38,2)) as refunded_amount
        from stg_refunds r join stg_payments p on r.payment_id = p.payment_id group by p.order_id""",
    "core_order_financial": """
        select o.order_id, o.customer_id, o.status as order_status, o.currency, o.ordered_at,
               cast(o.ordered_at as date) as order_date,
               cast(coalesce(g.gross_amount, 0) as decimal(38,2)) as gross_amount,
               cast(coalesce(p.paid_amount, 0) as decimal(38,2)) as paid_amount,
               cast(coalesce(r.refunded_amount, 0) as decimal(38,2)) as refunded_amount,
               cast(coalesce(p.paid_amount, 0) - coalesce(r.refunded_amount, 0) as decimal(38,2)) as net_amount
        from stg_orders o left join order_gross g on o.order_id = g.order_id
        left join order_paid p on o.order_id = p.order_id
        left join refunds_by_order r on o.order_id = r.order_id""",
    "mart_daily_revenue": """
        select cast(order_date as varchar) || ':' || currency as grain_key, order_date, currency,
               count(*) filter (where paid_amount > 0) as paid_orders,
               cast(sum(gross_amount) as decimal(38,2)) as gross_order_value,
               cast(sum(paid_amount) as decimal(38,2)) as captured_revenue,
               cast(sum(refunded_amount) as decimal(38,2)) as refunded_revenue,
               cast(sum(net_amount) as decimal(38,2)) as net_revenue
        from core_order_financial where paid_amount > 0 group by order_date, currency""",
    "mart_customer_orders": """
        select f.order_id, f.order_date, f.ordered_at, f.customer_id, c.email as customer_email, c.country,
               f.order_status, f.currency, f.gross_amount, f.paid_amount, f.refunded_amount, f.net_amount
        from core_order_financial f join stg_customers c on f.customer_id = c.customer_id""",
    "campaign_event_metrics": """
        select cast(occurred_at as date) as event_date, campaign_id,
               count(distinct case when event_type = 'product_viewed' then session_id end) as viewing_sessions,
               count(distinct case when event_type = 'add_to_cart' then session_id end) as cart_sessions,
               count(distinct case when event_type = 'checkout_completed' then session_id end) as checkout_sessions,
               count(distinct case when event_type = 'product_viewed' then customer_id end) as viewing_users
        from stg_events where campaign_id is not null group by 1, 2""",
    "daily_spend": """
        select spend_date as event_date, campaign_id, cast(sum(amount) as decimal(38,2)) as campaign_spend
        from stg_campaign_spend group by 1, 2""",
    "funnel_keys": """
        select event_date, campaign_id from campaign_event_metrics
        union select event_date, campaign_id from daily_spend""",
    "mart_conversion_funnel": """
        select k.event_date, k.campaign_id, coalesce(c.name, '') as campaign_name, coalesce(c.channel, '') as channel,
               coalesce(e.viewing_sessions, 0) as viewing_sessions, coalesce(e.cart_sessions, 0) as cart_sessions,
               coalesce(e.checkout_sessions, 0) as checkout_sessions, coalesce(e.viewing_users, 0) as viewing_users,
               cast(coalesce(s.campaign_spend, 0) as decimal(38,2)) as campaign_spend,
               case when coalesce(e.viewing_sessions, 0) = 0 then cast(0 as double)
                 else cast(e.checkout_sessions as double) / e.viewing_sessions end as session_conversion_rate
        from funnel_keys k
        left join campaign_event_metrics e on k.event_date = e.event_date and k.campaign_id = e.campaign_id
        left join daily_spend s on k.event_date = s.event_date and k.campaign_id = s.campaign_id
        left join stg_marketing_campaigns c on k.campaign_id = c.campaign_id""",
    "source_customers": "select 'cus_' || c_custkey::varchar as customer_id from customer where c_custkey % 13 <> 0",
    "live_customers": """
        select customer_id from raw_customers group by customer_id
        having not arg_max(is_deleted, row(source_updated_at, batch_id, record_hash))""",
    "net_of_source": """
        select cast((select coalesce(sum(amount), 0) from stg_payments where status = 'succeeded' and not is_deleted)
             - (select coalesce(sum(amount), 0) from stg_refunds where status = 'succeeded' and not is_deleted)
             as decimal(38,2)) as source_net""",
    "batch_manifest": """
        select 'batch_' || o_orderkey::varchar as batch_id, 'src_' || (o_custkey % 5)::varchar as source,
               cast(o_orderkey % 1000 as bigint) as row_count,
               case o_orderkey % 7 when 0 then 'FAILED' when 1 then 'LOADING' when 2 then 'QUARANTINED'
                 when 3 then 'STORED' else 'LOADED' end as status,
               cast(o_orderdate as timestamp) as created_at,
               cast(o_orderdate as timestamp) + to_hours(cast(o_orderkey % 48 as integer)) as updated_at
        from orders""",
    "pipeline_run": """
        select 'run_' || event_id::varchar as run_id,
               case event_id % 3 when 0 then 'PIPELINE' when 1 then 'BACKFILL' else 'PUBLISH' end as run_type,
               case event_type when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'SUCCESS' end as status,
               case when user_id % 6 <> 0 then 'src_' || (user_id % 5)::varchar end as source,
               cast(ts as timestamp) as started_at,
               case when event_type <> 'view'
                 then cast(ts as timestamp) + to_minutes(cast(event_id % 120 as integer)) end as finished_at
        from events""",
    "source_checkpoint": """
        select 'src_' || s_suppkey::varchar as source,
               timestamp '2024-01-28' + to_hours(cast(s_suppkey % 72 as integer)) as updated_at
        from supplier""",
    "publication_manifest": """
        select 'pub_' || event_id::varchar as publication_id,
               'run_' || (event_id - event_id % 2)::varchar as run_id,
               d.dataset, d.dataset || '__' || event_id::varchar as snapshot_table,
               case when event_id % 4 <> 0 then 'COMMITTED' else 'FAILED' end as status,
               case when event_id % 4 <> 0 then cast(ts as timestamp) end as committed_at,
               cast(ts as timestamp) as created_at
        from events join (values (0, 'mart_daily_revenue'), (1, 'mart_conversion_funnel'), (2, 'mart_customer_orders'))
          as d(place, dataset) on d.place = event_id % 3""",
    "dataset_release": """
        select 'rel_' || event_id::varchar as release_id, 'run_' || event_id::varchar as run_id,
               case event_id % 6 when 0 then 'PREPARING' when 1 then 'PARTIAL' when 2 then 'FAILED'
                 when 3 then 'ROLLED_BACK' else 'COMMITTED' end as status,
               cast(ts as timestamp) as created_at
        from events""",
    "problem_batches": """
        select source, status, count(*) as problems,
               max((epoch_us(timestamp '2024-01-31') - epoch_us(updated_at)) / 1e6) as max_age_seconds
        from batch_manifest where status in ('LOADING', 'FAILED', 'QUARANTINED') group by source, status""",
    "problem_runs": """
        select run_type, status, coalesce(source, '') as source, count(*) as problems,
               max((epoch_us(timestamp '2024-01-31') - epoch_us(coalesce(finished_at, started_at))) / 1e6)
                 as max_age_seconds
        from pipeline_run
        where started_at > timestamp '2024-01-31' - interval 24 hours and status in ('RUNNING', 'FAILED')
        group by run_type, status, coalesce(source, '')""",
    "checkpoint_ages": """
        select source, (epoch_us(timestamp '2024-01-31') - epoch_us(updated_at)) / 1e6 as age_seconds
        from source_checkpoint""",
    "publication_ages": """
        select dataset, (epoch_us(timestamp '2024-01-31') - epoch_us(max(committed_at))) / 1e6 as age_seconds
        from publication_manifest where status = 'COMMITTED' group by dataset""",
    "release_problems": """
        select status, count(*) as problems,
               max((epoch_us(timestamp '2024-01-31') - epoch_us(created_at)) / 1e6) as max_age_seconds
        from dataset_release where status in ('PREPARING', 'PARTIAL', 'FAILED') group by status""",
    "catalog_text": """
        select 'prod_' || p_partkey::varchar as product_id, p_name as product_name, p_type as category,
               case when p_partkey % 50 = 0 then 'not-a-decimal' when p_partkey % 7 = 0 then ''
                 else cast(p_retailprice as decimal(18,2))::varchar end as unit_cost,
               case when p_partkey % 90 = 1 then 'yesterday' else '2026-01-01T00:00:00Z' end as updated_at
        from part""",
    "revenue_row_text": f"select {_REVENUE_TEXT} as t, * from mart_daily_revenue",
}

QUERIES: dict[str, str] = {
    **{name: f"select * from {name}" for name in CTES if name.startswith("stg_")},
    **{
        name: f"select * from {name}"
        for name in (
            "order_gross", "order_paid", "refunds_by_order", "core_order_financial", "mart_daily_revenue",
            "mart_customer_orders", "campaign_event_metrics", "daily_spend", "funnel_keys", "mart_conversion_funnel",
            "problem_batches", "problem_runs", "checkpoint_ages", "publication_ages", "release_problems",
        )
    },
    "campaign_event_distincts": "select * from campaign_event_metrics",
    "extract_incremental": """
        select order_id, ordered_at, updated_at from raw_orders where updated_at >= timestamp '1998-01-31 22:00:00'""",
    "extract_lookback": """
        select 'orders' as table_name, count(*) as extracted, max(updated_at) as newest
        from raw_orders where updated_at >= timestamp '2024-01-19 22:00:00'
        union all
        select 'events', count(*), max(updated_at) from raw_events
        where occurred_at >= timestamp '2024-01-18 00:00:00'""",
    "backfill_window": """
        select event_id, event_type, occurred_at from raw_events
        where occurred_at >= timestamp '2024-01-10' and occurred_at < timestamp '2024-01-13'""",
    "source_watermark": """
        select max(updated_at) as updated_at from (
          select updated_at from raw_customers union all select updated_at from raw_orders
          union all select updated_at from raw_order_items union all select updated_at from raw_payments
          union all select updated_at from raw_refunds union all select updated_at from raw_events)""",
    "page_items": """
        select customer_id, email, updated_at::varchar as updated_at from raw_customers
        where updated_at >= timestamp '1995-01-02' and updated_at < timestamp '1995-01-03'""",
    "page_ingest": """
        select customer_id, email, country, updated_at,
               case when regexp_extract(customer_id, '[0-9]+')::bigint // 500 % 2 = 0 then 1 else 2 end as turn from raw_customers""",
    "landed_and_loaded": " union all ".join(
        f"select '{table}' as table_name, count(*) as row_count, count(distinct {key}) as keys, "
        f"count(*) filter (where is_deleted) as deleted, cast(1 as bigint) as batches from raw_{table}" for table, key in KEYS.items()),
    "stg_orders_incremental": "select * from stg_orders",
    "stg_customers_incremental": "select * from stg_customers",
    "mart_daily_revenue_delta": "select * from mart_daily_revenue",
    "load_all_pending": "select *, 2 as batches from (" + " union all ".join(_content(name) for name in sorted(RAW_TABLES)) + ")",
    "staged_load": """
        select case when n = 0 then 'after' else 'before' end as seen, order_id, customer_id, status, currency, ordered_at, updated_at, is_deleted
        from raw_orders, (select unnest([0, 1]) as n) where n = 0 or substr(order_id, 5)::bigint % 2 = 1""",
    "backfill_job": "select *, timestamp '2024-01-31' as published_at from mart_daily_revenue",
    "differing_rows": """
        select 'left' as side, order_id, customer_id, status, currency, ordered_at, updated_at, is_deleted from stg_orders
        where substr(order_id, 5)::bigint % 97 = 1 or substr(order_id, 5)::bigint % 89 = 2
        union all select 'right', order_id, customer_id, 'lost', currency, ordered_at, updated_at, is_deleted from stg_orders
        where substr(order_id, 5)::bigint % 89 = 2 and substr(order_id, 5)::bigint % 97 <> 1
        union all select 'right', order_id || '-new', customer_id, status, currency, ordered_at, updated_at, is_deleted
        from stg_orders where substr(order_id, 5)::bigint % 101 = 3""",
    "compacted_orders": "select order_id, customer_id, status, currency, ordered_at, updated_at, is_deleted from raw_orders",
    "campaign_months": """
        select strftime(occurred_at, '%Y%m') as month, campaign_id,
          count(distinct session_id) filter (where event_type = 'product_viewed') as viewing_sessions,
          count(distinct session_id) filter (where event_type = 'add_to_cart') as cart_sessions,
          count(distinct session_id) filter (where event_type = 'checkout_completed') as checkout_sessions,
          count(distinct customer_id) filter (where event_type = 'product_viewed') as viewing_users,
          true as within_bound
        from stg_events where campaign_id is not null group by 1, 2""",
    "generic_variant": """
        select customer_id, email, case when substr(customer_id, 5)::bigint % 2 = 1 then country end as country,
          case when substr(customer_id, 5)::bigint % 2 = 1 then substr(customer_id, 5)::bigint end as number, updated_at
        from raw_customers""",
    "late_events": """
        select e.event_id, e.ts, e.user_id, e.event_type, coalesce(e.ts < (
            select max(b.ts) from events b where b.event_id % 3 < e.event_id % 3) - interval 2 day, false) as is_late
        from events e""",
    "reconciled_keys": " union all ".join(
        f"select '{table}' as table_name, {KEYS[table]} as key from stg_{table} where substr(md5({KEYS[table]}), 1, 1) <> '0'"
        for table in RELATIONAL_TABLES),
    "landed_twice": "select t.*, true as reused, m.watermark from (" + " union all ".join(
        f"select '{table}' as table_name, count(*) as row_count from stg_{table}" for table in RELATIONAL_TABLES
    ) + ") t, (select max(w) as watermark from (" + " union all ".join(
        f"select max(updated_at) as w from stg_{table}" for table in RELATIONAL_TABLES) + ")) m",
    "kept_snapshots": """
        select 'run-' || n as run_id, count(*) as row_count, cast(sum(net_revenue) as decimal(38,2)) as net_revenue
        from mart_daily_revenue, (select unnest([2, 3, 4, 5]) as n) where day(order_date) % 6 < n group by n""",
    "catalog_flags": """
        select product_id, product_name, category, cast(nullif(unit_cost, '') as decimal(18,2)) as unit_cost,
               timestamp '2026-01-01' as updated_at, substr(product_id, 6)::bigint % 5 < 2 as is_deleted
        from catalog_text
        where (unit_cost = '' or try_cast(unit_cost as decimal(18,2)) is not null)
          and try_cast(updated_at as timestamptz) is not null""",
    "published_revenue": "select *, timestamp '2024-01-31' as published_at from mart_daily_revenue",
    "rolled_back_revenue": "select *, timestamp '2024-01-31' as published_at from mart_daily_revenue",
    "catalog_csv_scan": """
        select product_id, product_name, category, cast(nullif(unit_cost, '') as decimal(18,2)) as unit_cost,
               timestamp '2026-01-01' as updated_at, false as is_deleted
        from catalog_text
        where (unit_cost = '' or try_cast(unit_cost as decimal(18,2)) is not null)
          and try_cast(updated_at as timestamptz) is not null""",
    "csv_contract": """
        select product_id, unit_cost, updated_at,
               case when unit_cost <> '' and try_cast(unit_cost as decimal(18,2)) is null
                 then 'unit_cost is not numeric' else 'updated_at is not a timestamp' end as problem
        from catalog_text
        where (unit_cost <> '' and try_cast(unit_cost as decimal(18,2)) is null)
           or try_cast(updated_at as timestamptz) is null""",
    "raw_append_union": """
        select batch_id, count(*) as row_count, count(distinct customer_id) as customers
        from raw_customers group by batch_id""",
    "raw_audit_append": """
        select refund_id, payment_id, status, amount, succeeded_at, updated_at, is_deleted, 'b-1' as batch_id,
               updated_at as source_updated_at, timestamp '2024-01-31' as ingested_at, strftime(updated_at, '%Y%m') as load_month,
               sha256('{"amount":"' || amount::varchar || '","is_deleted":"' || is_deleted::varchar
                 || '","payment_id":"' || payment_id || '","refund_id":"' || refund_id || '","status":"' || status
                 || '","succeeded_at":' || coalesce('"' || succeeded_at::varchar || '"', 'null')
                 || ',"updated_at":"' || updated_at::varchar || '"}') as record_hash
        from raw_refunds""",
    "contract_projection": """
        select product_id, product_name, category, unit_cost, updated_at, is_deleted from raw_product_catalog""",
    "generic_landing": """
        select source, table_name, 'b-1' as batch_id, source_updated_at, timestamp '2024-01-31' as ingested_at,
               record_json, sha256(record_json) as record_hash from (
          select 'crm' as source, 'customers' as table_name, updated_at as source_updated_at,
                 '{"country":' || coalesce('"' || country || '"', 'null') || ',"customer_id":"' || customer_id
                   || '","email":"' || email || '","updated_at":"' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S')
                   || '.000Z"}' as record_json
          from raw_customers)""",
    "generic_fields": "select customer_id, email, country, updated_at from raw_customers",
    "business_columns": "select spend_id, campaign_id, spend_date, amount, updated_at, is_deleted from raw_campaign_spend",
    "source_fingerprint": "select sha256(concat_ws(':', count(*)::varchar, "
        + ", ".join(f"cast(sum({_slice('h', i)}) as decimal(38,0))::varchar" for i in range(5))
        + f")) as fingerprint from (select sha256({_row_text(product_id='text', product_name='text', category='text', unit_cost='text', updated_at='text')}) as h from catalog_text)",
    "snapshots_by_name": """
        select snapshot_table, created_at from publication_manifest where snapshot_table like 'mart_daily_revenue__%'""",
    "load_guard": """
        select b.batch_id, b.expected, coalesce(r.existing, 0) as existing,
               case when coalesce(r.existing, 0) = b.expected then 'skip'
                    when coalesce(r.existing, 0) = 0 then 'load' else 'fail' end as action
        from (select batch_id, count(*) + (case when batch_id like '%2' then 1 else 0 end) as expected
              from raw_customers group by batch_id) b
        left join (select batch_id, count(*) as existing from raw_customers where batch_id not like '%3'
                   group by batch_id) r on b.batch_id = r.batch_id""",
    "object_manifest": """
        select 'customer' as table_name, count(*) as row_count from customer
        union all select 'orders', count(*) from orders
        union all select 'supplier', count(*) from supplier""",
    "upsert_latest": """
        select customer_id, email, updated_at, batch_id from (
          select customer_id, email, updated_at, batch_id,
                 row_number() over (partition by customer_id
                   order by (case when batch_id like '%1' then 0 else 1 end) desc, updated_at desc, batch_id desc) as rn
          from raw_customers) where rn = 1""",
    "insert_if_absent": """
        select 'cus_' || o_custkey::varchar as customer_id, max(o_orderkey) as o_orderkey from orders
        where 'cus_' || o_custkey::varchar not in (select customer_id from live_customers)
        group by o_custkey""",
    "orders_in_extract_order": """
        select order_id, updated_at from raw_orders order by updated_at, order_id""",
    "left_join_defaults": """
        select k.event_date, k.campaign_id, coalesce(c.name, '') as name, coalesce(c.channel, '') as channel, c.ends_at
        from campaign_event_metrics k left join stg_marketing_campaigns c on k.campaign_id = c.campaign_id""",
    "live_keys": _live_keys("batch_id"),
    "live_keys_by_load": _live_keys("ingested_at"),
    "hard_delete_keys": """
        select customer_id from live_customers where customer_id not in (select customer_id from source_customers)""",
    "missing_keys": """
        select customer_id from live_customers except select customer_id from source_customers""",
    "tombstones": """
        select customer_id, email, country, created_at, timestamp '2026-02-01' as updated_at, true as is_deleted
        from stg_customers where customer_id not in (select customer_id from source_customers)""",
    "latest_row_for_keys": """
        select customer_id, email, country, created_at, updated_at, is_deleted from (
          select *, row_number() over (partition by customer_id
            order by source_updated_at desc, batch_id desc, record_hash desc) as rn from raw_customers)
        where rn = 1 and customer_id in (select customer_id from raw_orders)""",
    "released_runs": """
        select run_id, run_type, status from pipeline_run r
        where exists (select 1 from publication_manifest p where p.run_id = r.run_id)""",
    "source_net": "select * from net_of_source",
    "reconcile_net": """
        select gold_net, source_net, gold_rows, (gold_net = source_net and gold_rows > 0) as reconciled
        from (select cast(coalesce(sum(net_revenue), 0) as decimal(38,2)) as gold_net, count(*) as gold_rows
              from mart_daily_revenue), net_of_source""",
    "table_checksum": f"""
        select count(*) as row_count, {_checksum("h")} as checksum
        from (select sha256(t) as h from revenue_row_text)""",
    "batch_identity": _digest("refunds", "raw_refunds", _row_text(
        refund_id="text", payment_id="text", status="text", amount="number", succeeded_at="ts", updated_at="ts",
        is_deleted="bool", batch_id="text", source_updated_at="ts", ingested_at="ts", record_hash="text",
    )) + " union all " + _digest("campaign_spend", "raw_campaign_spend", _row_text(
        spend_id="text", campaign_id="text", spend_date="date", amount="number", updated_at="ts", is_deleted="bool",
        batch_id="text", source_updated_at="ts", ingested_at="ts", record_hash="text",
    )),
    "compare_tables": f"""
        select table_name, left_rows, left_checksum, right_rows, right_checksum,
               (left_rows = right_rows and left_checksum = right_checksum) as matches from (
          select 'mart_daily_revenue' as table_name,
                 count(*) as left_rows, {_checksum("h")} as left_checksum,
                 count(*) filter (where paid_orders > 1) as right_rows,
                 {_checksum("h", "filter (where paid_orders > 1)")} as right_checksum
          from (select paid_orders, sha256(t) as h from revenue_row_text)
          union all
          select 'mart_daily_revenue_copy', count(*), {_checksum("h")}, count(*), {_checksum("h")}
          from (select sha256(t) as h from revenue_row_text))""",
    "table_counts": """
        select 'customers' as table_name, count(*) as row_count from stg_customers
        union all select 'events', count(*) from stg_events
        union all select 'order_items', count(*) from stg_order_items
        union all select 'orders', count(*) from stg_orders
        union all select 'payments', count(*) from stg_payments
        union all select 'refunds', count(*) from stg_refunds""",
    "table_count_total": """
        select cast(sum(n) as bigint) as total_rows from (
          select count(*) as n from stg_customers union all select count(*) from stg_events
          union all select count(*) from stg_order_items union all select count(*) from stg_orders
          union all select count(*) from stg_payments union all select count(*) from stg_refunds)""",
    "keyset_page": """
        select customer_id, email, updated_at from stg_customers
        where customer_id > 'cus_12' and updated_at >= timestamp '1995-01-02' order by customer_id limit 100""",
    "keyset_next_cursor": """
        select case when count(*) = 100 then max(customer_id) end as next_cursor from (
          select customer_id from stg_customers
          where customer_id > 'cus_12' and updated_at >= timestamp '1995-01-02' order by customer_id limit 100)""",
    "snapshots_to_drop": """
        select dataset, snapshot_table from (
          select dataset, snapshot_table, row_number() over (partition by dataset
            order by created_at desc, snapshot_table desc) as rn from publication_manifest) where rn > 3""",
    "pending_batches": "select batch_id, created_at from batch_manifest where status in ('STORED', 'FAILED')",
    "orders_listing": """
        select order_id, customer_email, order_status, gross_amount, paid_amount, refunded_amount, net_amount
        from mart_customer_orders order by order_id limit 1000""",
    "funnel_listing": """
        select event_date, campaign_name, viewing_sessions, cart_sessions, checkout_sessions, campaign_spend
        from mart_conversion_funnel order by event_date, campaign_id limit 1000""",
    "daily_net_revenue": """
        select order_date, currency, cast(sum(net_revenue) as decimal(38,2)) as net_revenue
        from mart_daily_revenue group by order_date, currency""",
    "late_refund": """
        select d.grain_key, cast(d.refunded_revenue + coalesce(l.late, 0) as decimal(38,2)) as refunded_revenue,
               cast(d.net_revenue - coalesce(l.late, 0) as decimal(38,2)) as net_revenue
        from mart_daily_revenue d left join (
          select cast(ordered_at as date)::varchar || ':' || currency as grain_key,
                 sum(cast(10 as decimal(18,2))) as late
          from core_order_financial where paid_amount > 0 group by 1) l
        on d.grain_key = l.grain_key""",
    "duplicate_keys": """
        select order_item_id, count(*) as occurrences from raw_order_items group by order_item_id having count(*) > 1""",
    "null_counts": """
        select unnest(['customer_id', 'product_id', 'campaign_id', 'session_id']) as column_name,
               unnest([count(*) filter (where customer_id is null), count(*) filter (where product_id is null),
                       count(*) filter (where campaign_id is null), count(*) filter (where session_id is null)])
                 as null_rows
        from raw_events""",
    "funnel_not_monotonic": """
        select * from mart_conversion_funnel
        where checkout_sessions > cart_sessions or cart_sessions > viewing_sessions""",
    "negative_financials": """
        select * from mart_customer_orders
        where gross_amount < 0 or paid_amount < 0 or refunded_amount < 0 or refunded_amount > paid_amount""",
    "freshness": """
        select table_name, age as age_seconds,
               case when age is null or age > 259200 then 'error' when age > 93600 then 'warn' else 'pass' end as status
        from (
          select table_name, (epoch_us(timestamp '2024-02-01') - epoch_us(newest)) / 1e6 as age from (
            select 'campaign_spend' as table_name, max(ingested_at) as newest from raw_campaign_spend
            union all select 'customers', max(ingested_at) from raw_customers
            union all select 'events', max(ingested_at) from raw_events
            union all select 'marketing_campaigns', max(ingested_at) from raw_marketing_campaigns
            union all select 'order_items', max(ingested_at) from raw_order_items
            union all select 'orders', max(ingested_at) from raw_orders
            union all select 'payments', max(ingested_at) from raw_payments
            union all select 'product_catalog', max(ingested_at) from raw_product_catalog
            union all select 'refunds', max(ingested_at) from raw_refunds))""",
    "source_contract": """
        select 'events_type' as rule, count(*) filter (where event_type not in
            ('product_viewed', 'add_to_cart', 'checkout_completed')) as violations from raw_events
        union all select 'items_quantity', count(*) filter (where quantity <= 0) from raw_order_items
        union all select 'items_price', count(*) filter (where unit_price < 0) from raw_order_items
        union all select 'payments_amount', count(*) filter (where amount < 0) from stg_payments
        union all select 'refunds_amount', count(*) filter (where amount < 0) from raw_refunds
        union all select 'spend_amount', count(*) filter (where amount < 0) from raw_campaign_spend
        union all select 'orders_customer', count(*) from raw_orders
          where customer_id not in (select customer_id from raw_customers)
        union all select 'items_order', count(*) from raw_order_items
          where order_id not in (select order_id from raw_orders)
        union all select 'payments_order', count(*) from stg_payments
          where order_id not in (select order_id from raw_orders)
        union all select 'refunds_payment', count(*) from raw_refunds
          where payment_id not in (select payment_id from stg_payments)
        union all select 'spend_campaign', count(*) from raw_campaign_spend
          where campaign_id not in (select campaign_id from raw_marketing_campaigns)
        union all select 'payments_transaction_unique', count(*) from (
          select provider_transaction_id from stg_payments group by 1 having count(*) > 1)""",
    "mart_tests": """
        select 'unique mart_daily_revenue.grain_key' as test, count(*) as violations from (
          select grain_key from mart_daily_revenue where grain_key is not null group by 1 having count(*) > 1)
        union all select 'not_null mart_daily_revenue.' || unnest(['grain_key', 'order_date', 'currency', 'net_revenue']),
            unnest([count(*) filter (where grain_key is null), count(*) filter (where order_date is null),
                    count(*) filter (where currency is null), count(*) filter (where net_revenue is null)])
          from mart_daily_revenue
        union all select 'not_null mart_conversion_funnel.' || unnest(['event_date', 'campaign_id']),
            unnest([count(*) filter (where event_date is null), count(*) filter (where campaign_id is null)])
          from mart_conversion_funnel
        union all select 'unique mart_customer_orders.order_id', count(*) from (
          select order_id from mart_customer_orders where order_id is not null group by 1 having count(*) > 1)
        union all select 'not_null mart_customer_orders.' || unnest(['order_id', 'customer_id']),
            unnest([count(*) filter (where order_id is null), count(*) filter (where customer_id is null)])
          from mart_customer_orders
        union all select 'funnel monotonic', count(*) from mart_conversion_funnel
          where checkout_sessions > cart_sessions or cart_sessions > viewing_sessions
        union all select 'nonnegative financials', count(*) from mart_customer_orders
          where gross_amount < 0 or paid_amount < 0 or refunded_amount < 0 or refunded_amount > paid_amount""",
    "gold_rows": """
        select 'mart_conversion_funnel' as table_name, count(*) as row_count from mart_conversion_funnel
        union all select 'mart_customer_orders', count(*) from mart_customer_orders
        union all select 'mart_daily_revenue', count(*) from mart_daily_revenue""",
    "slo_breaches": """
        select m.metric, subject, value, threshold from (
          select 'batch_problem_age' as metric, source || '/' || status as subject, max_age_seconds as value
          from problem_batches
          union all select 'run_problem_age', run_type || '/' || status || '/' || source, max_age_seconds
          from problem_runs
          union all select 'release_problem_age', status, max_age_seconds from release_problems
          union all select 'checkpoint_age', source, age_seconds from checkpoint_ages
          union all select 'publication_age', dataset, age_seconds from publication_ages) m
        join (values ('batch_problem_age', 1800::double), ('run_problem_age', 1800::double),
                     ('release_problem_age', 900::double), ('checkpoint_age', 93600::double),
                     ('publication_age', 93600::double)) as limits(metric, threshold)
          on m.metric = limits.metric
        where value > threshold""",
    "streamed_revisions": "select * from stg_events",
    "streamed_distinct_events": "select event_id, ts, user_id, event_type from events",
    "streamed_funnel_metrics": "select * from campaign_event_metrics",
}


def _needs(text: str) -> list[str]:
    """The expressions a text names, in the order they are defined."""
    words = set(re.findall(r"[a-z_]+", text))
    return [name for name in CTES if name in words]


def sql(query: str) -> str:
    """The full text of one query."""
    body = QUERIES[query]
    wanted: set[str] = set()
    waiting = _needs(body)
    while waiting:
        name = waiting.pop()
        if name not in wanted:
            wanted.add(name)
            waiting.extend(n for n in _needs(CTES[name]) if n != name)
    parts = [f"{name} as ({CTES[name]})" for name in CTES if name in wanted]
    return f"with {', '.join(parts)} {body}" if parts else body
