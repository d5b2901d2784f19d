"""The same queries as SQL over the same tables, for checking results."""

from __future__ import annotations

_LINES = """
lines as (
  select case l_returnflag when 'R' then 'd' when 'A' then 'u' else 'c' end as op,
         l_orderkey * 8 + l_linenumber as txn_id, l_orderkey as order_id,
         cast(l_suppkey as int) as store_id, cast(l_partkey as int) as product_id,
         cast(l_quantity as int) as qty, cast(l_extendedprice as decimal(12,2)) as total_amount,
         case l_linestatus when 'F' then 'completed' else 'pending' end as status, l_shipdate as shipped_at
  from lineitem),
last_lines as (
  select * exclude (rn) from (
    select *, row_number() over (partition by txn_id order by shipped_at desc, product_id desc, store_id desc) as rn
    from lines) where rn = 1)"""

_SALES = _LINES + """,
sales as (select * from last_lines where op <> 'd'),
sales_transactions as (
  select txn_id, store_id, product_id, cast(o_custkey as int) as customer_id, qty, total_amount, status
  from sales left join orders on order_id = o_orderkey)"""

_CUSTOMERS = """
customer_changes as (
  select 'r' as op, cast(c_custkey as int) as customer_id, c_name as name, c_mktsegment as loyalty_tier,
         cast(c_acctbal as decimal(12,2)) as total_spend, timestamp '1970-01-01 00:00:00' as ts, -1 as seq
  from customer
  union all
  select case event_type when 'error' then 'd' when 'signup' then 'c' else 'u' end, cast(user_id as int), c_name,
         event_type, cast(value as decimal(12,2)), ts, event_id
  from events left join customer on user_id = c_custkey),
customers as (
  select customer_id, name, loyalty_tier, total_spend from (
    select *, row_number() over (partition by customer_id order by ts desc, seq desc) as rn from customer_changes)
  where rn = 1 and op <> 'd')"""

_SUMMARY = """
select store_id, product_id, cast(sum(qty) as bigint) as total_qty, cast(sum(total_amount) as double) as total_amount,
       count(*) as txn_count, timestamp '{at}' as updated_at
from {source} where status = 'completed' group by store_id, product_id"""

_LOYALTY = """
select c.customer_id, any_value(c.name) as name, any_value(c.loyalty_tier) as loyalty_tier,
       cast(any_value(c.total_spend) as double) as lifetime_spend, count(t.txn_id) as txn_count,
       timestamp '{at}' as updated_at
from {customers} c left join {sales} t on t.customer_id = c.customer_id group by c.customer_id"""

_FIRST, _SECOND = "2024-01-01 00:00:00", "2024-02-01 00:00:00"

_SNAPSHOT = """
loaded as (
  select cast(c_custkey as int) as customer_id, c_name as name, c_mktsegment as loyalty_tier,
         cast(c_acctbal as decimal(12,2)) as total_spend from customer)"""

_EARLY = _SALES + """,
early as (
  select * from (
    select *, row_number() over (partition by txn_id order by shipped_at desc, product_id desc, store_id desc) as rn
    from lines where shipped_at < timestamp '1998-01-01') where rn = 1 and op <> 'd'),
old_summary as (""" + _SUMMARY.format(source="early", at=_FIRST) + """),
new_summary as (""" + _SUMMARY.format(source="sales", at=_SECOND) + """),
merged as (
  select * from new_summary
  union all
  select o.* from old_summary o
  where not exists (select 1 from new_summary n where n.store_id = o.store_id and n.product_id = o.product_id))"""

_LOG = """
event_log as (
  select case event_type when 'signup' then 'customers' when 'purchase' then 'sales_transactions'
                         when 'view' then 'products' when 'click' then 'stores' else 'errors' end as table_name,
         ts as committed_at from events)"""

_GRAPH = """
graph(gold_table, depends_on_silver_table) as (values
  ('gold.sales_summary', 'sales_transactions'), ('gold.sales_summary', 'products'), ('gold.sales_summary', 'stores'),
  ('gold.customer_loyalty', 'customers'), ('gold.customer_loyalty', 'sales_transactions'))"""

_ORDERS = """
env as (
  select case o_orderstatus when 'F' then 'd' when 'P' then 'u' else 'c' end as op, o_orderkey, o_orderpriority,
         case o_orderpriority when '2-HIGH' then -1 - o_orderkey else o_orderkey end as new_key,
         cast(o_custkey as int) as customer_id, cast(o_totalprice as decimal(12,2)) as total_amount,
         o_orderstatus as status, epoch_ms(o_orderdate) as ts_ms
  from orders)"""

_LAST_CHANGE = """
product_last as (
  select * from (
    select cast(l_partkey as int) as product_id, cast(l_extendedprice as decimal(12,2)) as unit_price,
           l_returnflag <> 'R' as is_active,
           row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc,
                              l_suppkey desc) as rn from lineitem) where rn = 1),
store_last as (
  select * from (
    select cast(l_suppkey as int) as store_id, l_linestatus, l_returnflag <> 'R' as is_active,
           row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc,
                              l_partkey desc) as rn from lineitem) where rn = 1)"""

_SALES_COLUMNS = "txn_id, store_id, product_id, customer_id, qty, total_amount, status"

_IMAGE = ("txn_id", "store_id", "product_id", "customer_id", "qty", "unit_price", "total_amount", "status", "name",
          "loyalty_tier", "total_spend", "category", "brand", "is_active", "city", "region")


def _image(**known: str) -> str:
    """The fields of a row image as text, in order; those that a table lacks are NULL."""
    return " || '|' || ".join(f"coalesce(cast({known[c]} as varchar), '~')" if c in known else "'~'" for c in _IMAGE)


ORACLE = {
    "cdc_scan": f"""
        with sent as (
          select 'sales_transactions' as t, l_orderkey * 8 + l_linenumber as key,
                 l_partkey * 2147483648 + l_suppkey as "offset", epoch_ms(l_shipdate) as ts_ms,
                 case l_returnflag when 'R' then 'd' when 'A' then 'u' else 'c' end as op,
                 {_image(txn_id="l_orderkey * 8 + l_linenumber", store_id="l_suppkey", product_id="l_partkey",
                         customer_id="o_custkey", qty="cast(l_quantity as int)",
                         total_amount="cast(l_extendedprice as decimal(12,2))",
                         status="case l_linestatus when 'F' then 'completed' else 'pending' end")} as image
          from lineitem left join orders on l_orderkey = o_orderkey
          union all
          select 'customers', c_custkey, -1, 0, 'r',
                 {_image(customer_id="c_custkey", name="c_name", loyalty_tier="c_mktsegment",
                         total_spend="cast(c_acctbal as decimal(12,2))")}
          from customer
          union all
          select 'customers', user_id, event_id, epoch_us(ts) // 1000,
                 case event_type when 'error' then 'd' when 'signup' then 'c' else 'u' end,
                 {_image(customer_id="user_id", name="c_name", loyalty_tier="event_type",
                         total_spend="cast(value as decimal(12,2))")}
          from events left join customer on user_id = c_custkey
          union all
          select 'products', p_partkey, -1, 0, 'r',
                 {_image(product_id="p_partkey", unit_price="cast(p_retailprice as decimal(12,2))", name="p_name",
                         category="p_type", brand="p_brand", is_active="p_size > 0")}
          from part
          union all
          select 'products', l_partkey, (l_orderkey * 8 + l_linenumber) * 16777216 + l_suppkey, epoch_ms(l_shipdate), 'u',
                 {_image(product_id="l_partkey", unit_price="cast(l_extendedprice as decimal(12,2))", name="p_name",
                         category="p_type", brand="p_brand", is_active="l_returnflag <> 'R'")}
          from lineitem left join part on l_partkey = p_partkey
          union all
          select 'stores', s_suppkey, -1, 0, 'r',
                 {_image(store_id="s_suppkey", name="s_name", city="n_name", region="r_name")}
          from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
          union all
          select 'stores', l_suppkey, (l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey,
                 epoch_ms(l_shipdate), case l_linestatus when 'F' then 'd' else 'u' end,
                 {_image(store_id="l_suppkey", name="s_name", city="n_name", region="r_name", is_active="l_returnflag <> 'R'")}
          from lineitem left join supplier on l_suppkey = s_suppkey
          left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey)
        select 'retail.dbo.' || t as topic, key, 0::int as partition, "offset", make_timestamp(ts_ms * 1000) as timestamp,
               op, case when op in ('u', 'd') then image end as before_row, case when op <> 'd' then image end as after_row,
               ts_ms as source_ts_ms, ts_ms
        from sent""",
    "cdc_include": """
        select event_type, event_id, user_id from events
        where event_type in ('click', 'purchase', 'signup', 'view')""",
    "snapshot_envelope": f"""with {_SNAPSHOT}
        select 'r' as op, true as before_is_null, *, cast(0 as bigint) as source_ts_ms, cast(-1 as bigint) as "offset"
        from loaded""",
    "snapshot_diff": """
        with old as (select o_orderkey, o_orderstatus as status, o_totalprice from orders where o_orderstatus <> 'O'),
        new as (
          select o_orderkey, case o_orderpriority when '1-URGENT' then 'S' else o_orderstatus end as status, o_totalprice
          from orders where o_orderstatus <> 'P')
        select case when old.o_orderkey is null then 'c' when new.o_orderkey is null then 'd' else 'u' end as op,
               coalesce(old.o_orderkey, new.o_orderkey) as o_orderkey, old.status as old_status,
               new.status as new_status, old.o_totalprice as old_price, new.o_totalprice as new_price
        from old full outer join new on old.o_orderkey = new.o_orderkey
        where old.o_orderkey is null or new.o_orderkey is null or old.status is distinct from new.status
           or old.o_totalprice is distinct from new.o_totalprice""",
    "gold_scan": f"""with {_SALES} {_SUMMARY.format(source="sales", at=_SECOND)}""",
    "decode_lenient": f"""with {_ORDERS}
        select op, case op when 'd' then o_orderkey else new_key end as txn_id,
               case o_orderpriority when '1-URGENT' then null else 1 end as qty, total_amount, status,
               ts_ms as source_ts_ms
        from env where o_orderpriority <> '5-LOW'""",
    "decode_changelog": f"""with {_ORDERS}
        select op, case op when 'd' then o_orderkey else new_key end as txn_id, customer_id, total_amount, ts_ms,
               o_orderkey as "offset" from env
        union all
        select 'd', o_orderkey, customer_id, total_amount, ts_ms, o_orderkey from env
        where op = 'u' and new_key <> o_orderkey""",
    "completed_sales": f"with {_SALES} select * from sales_transactions where status = 'completed'",
    "raw_ingest": f"""with {_LINES}
        select op, case when op <> 'c' then txn_id end as before_txn_id, case when op <> 'd' then txn_id end as after_txn_id,
               case when op <> 'd' then cast(o_custkey as int) end as after_customer_id,
               case when op <> 'd' then total_amount end as after_total_amount, epoch_ms(shipped_at) as source_ts_ms
        from lines left join orders on order_id = o_orderkey""",
    "silver_customers": f"with {_CUSTOMERS} select * from customers",
    "silver_products": f"""with {_LAST_CHANGE}
        select cast(coalesce(p_partkey, l.product_id) as int) as product_id, p_name as name, p_type as category,
               p_brand as brand, coalesce(l.unit_price, cast(p_retailprice as decimal(12,2))) as unit_price,
               coalesce(l.is_active, p_size > 0) as is_active
        from part full join product_last l on l.product_id = p_partkey""",
    "silver_sales_transactions": f"with {_SALES} select {_SALES_COLUMNS} from sales_transactions",
    "silver_stores": f"""with {_LAST_CHANGE}
        select cast(coalesce(s_suppkey, l.store_id) as int) as store_id, s_name as name, n_name as city, r_name as region,
               l.is_active
        from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
        full join store_last l on l.store_id = s_suppkey where coalesce(l.l_linestatus, '') <> 'F'""",
    "silver_deletes": f"""with {_LINES}
        select txn_id, epoch_ms(shipped_at) as ts_ms from last_lines where op = 'd'""",
    "silver_stream_sales": f"with {_SALES} select {_SALES_COLUMNS} from sales_transactions",
    "silver_stream_compacted": f"with {_CUSTOMERS} select * from customers",
    "silver_late_changes": f"with {_SALES} select {_SALES_COLUMNS} from sales_transactions",
    "independent_streams": f"""with {_SALES}, {_CUSTOMERS}, {_LAST_CHANGE}
        select 'raw' as layer, 'customers' as table_name, count(*) as n_rows from customer_changes
        union all select 'change_log', 'customers', count(*) from customer_changes
        union all select 'silver', 'customers', count(*) from customers
        union all select 'raw', 'sales_transactions', count(*) from lines
        union all select 'change_log', 'sales_transactions', count(*) from lines
        union all select 'silver', 'sales_transactions', count(*) from sales_transactions
        union all select layer, 'products', (select count(*) from part) + (select count(*) from lineitem)
        from (values ('raw'), ('change_log')) t(layer)
        union all select layer, 'stores', (select count(*) from supplier) + (select count(*) from lineitem)
        from (values ('raw'), ('change_log')) t(layer)
        union all select 'silver', 'products', count(*) from (select p_partkey from part union select l_partkey from lineitem)
        union all select 'silver', 'stores', count(*) from supplier full join store_last l on l.store_id = s_suppkey
        where coalesce(l.l_linestatus, '') <> 'F'""",
    "merge_sales_summary": f"with {_EARLY} select * from merged",
    "merge_customer_loyalty": f"""with {_SALES}, {_SNAPSHOT},
        targeted as (select * from loaded where loyalty_tier <> 'BUILDING'),
        others as (select * from loaded where loyalty_tier <> 'MACHINERY'),
        finished as (select * from sales_transactions where status = 'completed'),
        old_loyalty as ({_LOYALTY.format(customers="targeted", sales="finished", at=_FIRST)}),
        new_loyalty as ({_LOYALTY.format(customers="others", sales="sales_transactions", at=_SECOND)})
        select * from new_loyalty
        union all
        select * from old_loyalty o where not exists (select 1 from new_loyalty n where n.customer_id = o.customer_id)""",
    "change_log": f"""with {_LINES}
        select 'sales_transactions' as table_name,
               cast(year(shipped_at) * 100 + month(shipped_at) as bigint) as snapshot_id,
               cast(txn_id as varchar) as affected_keys, shipped_at as committed_at from lines""",
    "change_log_rollup": f"""with {_LINES},
        log as (select cast(year(shipped_at) * 100 + month(shipped_at) as bigint) as snapshot_id, txn_id,
                       cast(txn_id as varchar) as affected_keys, shipped_at as committed_at from lines)
        select 'sales_transactions' as table_name, snapshot_id, txn_id // 1000 as key_bucket,
               '[' || string_agg(distinct '"' || affected_keys || '"', ',' order by '"' || affected_keys || '"') || ']'
                 as affected_keys,
               count(distinct affected_keys) as n_keys, count(*) as n_changes, max(committed_at) as committed_at
        from log group by snapshot_id, txn_id // 1000""",
    "create_if_absent": f"""with {_SALES} {_SUMMARY.format(source="sales", at=_SECOND)}""",
    "insert_if_absent": """
        with existing as (
          select user_id, event_type, max(event_id) as edge_id from events where value < 5 group by user_id, event_type)
        select * from existing
        union all
        select user_id, event_type, min(event_id) from events e
        where not exists (select 1 from existing x where x.user_id = e.user_id and x.event_type = e.event_type)
        group by user_id, event_type""",
    "sales_summary": f"with {_SALES} {_SUMMARY.format(source='sales', at=_SECOND)}",
    "customer_loyalty": f"""with {_SALES}, {_CUSTOMERS}
        {_LOYALTY.format(customers="customers", sales="sales_transactions", at=_SECOND)}""",
    "left_join_counts": """
        select cast(c_custkey as int) as customer_id, any_value(c_name) as name,
               count(*) filter (o_orderpriority = '1-URGENT' and o_orderstatus = 'P') as txn_count
        from customer left join orders on o_custkey = c_custkey group by c_custkey""",
    "sum_types": f"""with {_LINES}
        select op, status, cast(sum(qty) as bigint) as sum_int, sum(total_amount) as sum_decimal,
               cast(sum(total_amount) as double) as sum_double, count(*) as n_rows
        from lines group by op, status""",
    "job_name": """
        select p_partkey, 'gold.' || lower(replace(p_name, ' ', '_')) || '_' || lower(p_type) as gold_table,
               replace(lower(replace(p_name, ' ', '_')) || '_' || lower(p_type), '_', '-') as job_name
        from part""",
    "impacted_gold": f"""with {_LOG}, {_GRAPH}
        select distinct gold_table from graph
        where depends_on_silver_table in (select table_name from event_log where committed_at > timestamp '2024-01-20')
        order by gold_table""",
    "next_watermark": f"""with {_LOG}
        select coalesce(max(committed_at), timestamp '2024-01-20') as watermark
        from event_log where committed_at > timestamp '2024-01-20'""",
    "selective_refresh": f"""with {_SALES}, {_CUSTOMERS}
        select 'gold.sales_summary' as gold_table, false as in_tick_1, true as in_tick_2, false as in_tick_3,
               count(*) as n_rows, cast(sum(txn_count) as bigint) as n_sales
        from ({_SUMMARY.format(source="sales_transactions", at=_SECOND)})
        union all
        select 'gold.customer_loyalty', true, true, false, count(*), cast(sum(txn_count) as bigint)
        from ({_LOYALTY.format(customers="customers", sales="sales_transactions", at=_SECOND)})""",
    "expired_snapshots": """
        select table_name, snapshot_id, committed_at from (
          select event_type as table_name, event_id as snapshot_id, ts as committed_at,
                 row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events)
        where rn > 10 and committed_at < timestamp '2100-01-01'""",
    "orphans": """
        select 'file:///tables/part-' || o_orderkey as path, o_orderdate as modified_at from orders
        where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
    "maintenance_report": """
        with ranked as (
          select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as rn
          from events where event_type in ('click', 'error', 'purchase', 'signup', 'view'))
        select event_type as table_name, 'expire_snapshots' as step, 'done' as status,
               count(*) filter (rn > 10) as items from ranked group by event_type
        union all
        select event_type, 'remove_orphan_files', 'done', count(*) filter (not coalesce(value >= 50, false))
        from ranked group by event_type
        union all select 'lost', 'expire_snapshots', 'failed', 0""",
    "governed_loyalty": f"""with {_SALES}, {_CUSTOMERS}
        select * exclude (name, lifetime_spend) from (
          {_LOYALTY.format(customers="customers", sales="sales_transactions", at=_SECOND)})""",
    "access_audit": """
        with requests as (
          select user_id as who, case when event_type in ('view', 'click') then 'analyst_readonly' else 'engineer' end as role,
                 'customer_loyalty' as table_name,
                 case when value < 10 then 'name' when value < 20 then 'lifetime_spend' else 'txn_count' end as column_name,
                 ts as requested_at from events)
        select *, case when role = 'analyst_readonly' and column_name in ('name', 'lifetime_spend')
                       then 'denied' else 'allowed' end as decision
        from requests""",
    "raw_counts": f"""with {_LINES}
        select 'sales_transactions' as table_name, op, count(*) as n_rows from lines group by op
        union all
        select 'customers', case event_type when 'error' then 'd' when 'signup' then 'c' else 'u' end, count(*)
        from events group by 2
        union all select 'customers', 'r', count(*) from customer""",
    "silver_reconcile": f"""with {_SALES}
        select txn_id, case when op = 'd' then 'stale' when qty = 50 then 'missing' else 'different' end as status
        from last_lines where (op = 'd' and qty = 7) or (op <> 'd' and qty in (1, 50))""",
    "changelog_gaps": f"""with {_LINES}
        select 'sales_transactions' as table_name, cast(txn_id as varchar) as affected_keys
        from lines group by txn_id having count(*) filter (op <> 'd') = 0""",
    "gold_reconcile": f"""with {_EARLY}
        select store_id, product_id, 'stale' as status from old_summary o
        where not exists (select 1 from new_summary n where n.store_id = o.store_id and n.product_id = o.product_id)""",
}

# Aggregates that follow their changes equal a recomputation.
for _name in ("sales_summary", "customer_loyalty"):
    ORACLE[f"incremental_{_name}"] = ORACLE[_name]
ORACLE |= {
    "silver_keyed_state": ORACLE["silver_stream_sales"],
    "snapshot_diff_digest": ORACLE["snapshot_diff"],
    "gold_reconcile_digest": ORACLE["gold_reconcile"],
    "raw_variant": ORACLE["raw_ingest"],
    "merge_bucketed": ORACLE["merge_sales_summary"],
    "change_log_lookup": f"""with {_LINES}
        select 'sales_transactions' as table_name, cast(year(shipped_at) * 100 + month(shipped_at) as bigint) as snapshot_id,
               cast(txn_id as varchar) as affected_keys, shipped_at as committed_at
        from lines where shipped_at >= timestamp '1994-01-01'
          and txn_id in (select txn_id from lines order by total_amount desc, txn_id limit 10)""",
    "change_log_rollup_ranked": f"""with {_LINES},
        log as (
          select cast(year(shipped_at) * 10 + quarter(shipped_at) as bigint) as snapshot_id, shipped_at as committed_at,
                 '{{"order_id":' || order_id || ',"line":' || (txn_id % 8) || '}}' as k from lines),
        keyed as (
          select snapshot_id, k, count(*) as n, max(committed_at) as committed_at,
                 (row_number() over (partition by snapshot_id order by k) - 1) // 1000 as part from log group by snapshot_id, k)
        select 'sales_transactions' as table_name, snapshot_id, part,
               '[' || string_agg('"' || replace(k, '"', '\\"') || '"', ',' order by k) || ']' as affected_keys,
               count(*) as n_keys, cast(sum(n) as bigint) as n_changes, max(committed_at) as committed_at
        from keyed group by snapshot_id, part""",
}
