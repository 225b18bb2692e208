SELECT o_orderpriority AS priority, count(*) AS orders, CAST(min(o_orderdate) AS DATE) AS first_day
FROM {orders}
GROUP BY ALL;

SELECT o_orderstatus AS priority, count(*) AS orders, CAST(min(o_orderdate) AS DATE) AS first_day
FROM {orders}
GROUP BY ALL
