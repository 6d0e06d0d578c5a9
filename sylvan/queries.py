"""The library's own queries: for each a text in the query language, and SQL for the same rows.

Named after the operator families they exercise.  Sums are rounded because their order is not fixed.
"""

from __future__ import annotations

from . import catalog
from .engine import Engine

# name: (source, query text, SQL or None)
_T = "tables"
QUERIES: dict[str, tuple[str, str, str | None]] = {
    # scans, filters, comparisons
    "n1_table_scan": (_T, "/nation/* | rec(::n_nationkey, ::n_name)", "SELECT n_nationkey, n_name FROM nation"),
    "n1_key_lookup": (_T, "/orders/7 | rec(::o_orderkey, ::o_totalprice)", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7"),
    "f1_filter": (_T, "/lineitem/*[::l_quantity > 45 and ::l_discount < 0.03] | rec(::l_orderkey, ::l_extendedprice)", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03"),
    "f4_stage_filter": (_T, "/orders/* | [::o_totalprice >= 300000] | ::o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice >= 300000"),
    "f5_not_or": (_T, "/customer/*[not (::c_acctbal > 0) or ::c_mktsegment = 'BUILDING'] | ::c_custkey", "SELECT c_custkey AS value FROM customer WHERE NOT coalesce(c_acctbal > 0, false) OR c_mktsegment = 'BUILDING'"),
    "f6_regex": (_T, "/part/*[::p_name =~ /^small .*g$/] | rec(::p_partkey, ::p_name)", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^small .*g$')"),
    "f6_not_regex": (_T, "/part/*[::p_type !~ /^E/] @| count", "SELECT count(*) AS value FROM part WHERE NOT regexp_matches(p_type, '^E')"),
    "f6_contains": (_T, "/part/*[::p_name *= 'ring'] | ::p_partkey", "SELECT p_partkey AS value FROM part WHERE contains(p_name, 'ring')"),
    "f6_instant": (_T, "/orders/*[::o_orderdate >= 1998-01-01 and ::o_orderdate < 1998-02-01] @| count", "SELECT count(*) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01'"),
    "f2_position": (_T, "/customer/*[3]::c_name", "SELECT c_name AS value FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 2"),
    "f2_from_end": (_T, "/customer/*[-1]::c_custkey", "SELECT max(c_custkey) AS value FROM customer"),
    "f3_range": (_T, "/customer/*[5..9]::c_custkey", "SELECT c_custkey AS value FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n BETWEEN 5 AND 9"),
    "f7_exists": (_T, "/labels/*[->doc_id] @| count", "SELECT count(*) AS value FROM labels WHERE doc_id IS NOT NULL"),
    "f7_exists_link": (_T, "/customer/*[<-o_custkey] | ::c_custkey", "SELECT c_custkey AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "f8_membership": (_T, "/customer/*[::c_custkey = ^/orders/*[::o_totalprice > 400000]::o_custkey] | ::c_name", "SELECT c_name AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "f8_not_member": (_T, "/supplier/*[not ::s_nationkey = ^/customer/*[::c_acctbal > 9900]::c_nationkey] | ::s_suppkey", "SELECT s_suppkey AS value FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    "f9_conditional": (_T, "/orders/* | rec(::o_orderkey, 'size', (::o_totalprice > 200000 ? 'big' : ::o_totalprice > 100000 ? 'mid' : 'small'))", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders"),
    "f10_value_match": (_T, "/orders/* | rec(::o_orderkey, 's', (::o_orderstatus ?= 'F' ? 1 : 'O' ? 2 : 3))", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s FROM orders"),
    # arithmetic, registers, records
    "a1_arithmetic": (_T, "/lineitem/*[::l_quantity > 48] | rec(::l_orderkey, ::l_linenumber, 'net', ::l_extendedprice * (1 - ::l_discount))", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 48"),
    "a3_integer_division": (_T, "/orders/* | rec(::o_orderkey, 'd', ::o_orderkey idiv 7, 'm', ::o_orderkey mod 7)", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m FROM orders"),
    "a6_instants": (_T, "/orders/* | rec(::o_orderkey, 'days', epoch(::o_orderdate) - epoch(1998-01-01))", "SELECT o_orderkey, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1998-01-01') AS BIGINT) AS days FROM orders"),
    "j13_registers": (_T, "/customer/*[::c_acctbal > 9000] | .name(::c_name) | .twice(::c_acctbal * 2) | %.", "SELECT c_name AS name, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 9000"),
    "j16_ordinal": (_T, "/nation/* @| sort_by(::n_name) | rec($ord, ::n_name)", "SELECT row_number() OVER (ORDER BY n_name) AS ordinal, n_name FROM nation"),
    "j17_captures": (_T, "/customer/* | [::c_name =~ /#0*(\\d+)$/] | rec(::c_custkey, 'digits', $1)", "SELECT c_custkey, regexp_extract(c_name, '#0*(\\d+)$', 1) AS digits FROM customer WHERE regexp_matches(c_name, '#0*(\\d+)$')"),
    "s12_interpolation": (_T, '/nation/* | "${::n_name} (${::n_regionkey})"', "SELECT n_name || ' (' || n_regionkey || ')' AS value FROM nation"),
    # joins
    "k1_existential": (_T, "/orders/*[::o_totalprice > 300000] <=> /customer/*[::c_custkey = $$::o_custkey] | rec(::o_orderkey, 'who', $*1::c_name)", "SELECT o_orderkey, c_name AS who FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000"),
    "k1_first_witness": (_T, "/customer/* <=> /orders/*[::o_custkey = $$::c_custkey] | rec(::c_custkey, 'first', $*1::o_orderkey)", "SELECT c_custkey, min(o_orderkey) AS first FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "k2_theta": (_T, "/nation/* <=> /nation/*[::n_regionkey = $$::n_regionkey and ::n_nationkey > $$::n_nationkey] | rec(::n_nationkey, 'next', $*1::n_nationkey)", "SELECT a.n_nationkey, min(b.n_nationkey) AS next FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey GROUP BY a.n_nationkey"),
    "k3_multi_way": (_T, "/orders/*[::o_totalprice > 350000] <=> /customer/*[::c_custkey = $$::o_custkey] <=> /nation/*[::n_nationkey = $*1::c_nationkey] | rec(::o_orderkey, 'nation', $*2::n_name)", "SELECT o_orderkey, n_name AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 350000"),
    "k6_left_semi": (_T, "/customer/* <=> /orders/*[::o_custkey = $$::c_custkey] @| count", "SELECT count(*) AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "k7_fk_chain": (_T, "/orders/* | rec(::o_orderkey, 'region', ::o_custkey-->::c_nationkey-->::n_regionkey-->::r_name)", "SELECT o_orderkey, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "k8_reverse_fk": (_T, "/nation/3<-c_nationkey::c_custkey", "SELECT c_custkey AS value FROM customer WHERE c_nationkey = 3"),
    "k9_fan_out": (_T, "/nation/*[::n_regionkey = 1]<-s_nationkey | rec(::s_suppkey, ::s_name)", "SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"),
    "n11_resolve": (_T, "/supplier/*::s_nationkey-->::n_regionkey-->::r_name", "SELECT r_name AS value FROM (SELECT DISTINCT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"),
    "n12_reverse_resolve": (_T, "/region/2::n_regionkey<--::n_name", "SELECT n_name AS value FROM nation WHERE n_regionkey = 2"),
    "n16_union": (_T, "/customer/*[::c_acctbal > 9500]::c_name || /customer/*[::c_mktsegment = 'BUILDING']::c_name", "SELECT c_name AS value FROM customer WHERE c_acctbal > 9500 OR c_mktsegment = 'BUILDING'"),
    "k11_mounts": ("mount", "/db/orders/*[::o_custkey = ^/crm/customer/*[::c_acctbal > 9800]::c_custkey] | ::o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9800)"),
    # aggregation
    "g1_count": (_T, "/lineitem/* @| count", "SELECT count(*) AS value FROM lineitem"),
    "g2_sum": (_T, "/lineitem/*::l_extendedprice @| sum | round(0)", "SELECT round(sum(l_extendedprice), 0) AS value FROM lineitem"),
    "g5_mean": (_T, "/customer/* | ::c_acctbal @| group(::c_mktsegment) | mean | .m | rec($.c_mktsegment, 'm', ($.m | round(4)))", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1"),
    "g6_median": (_T, "/customer/*::c_acctbal @| group(::c_nationkey) | median | .m | rec($.c_nationkey, 'm', ($.m | round(4)))", "SELECT c_nationkey, round(median(c_acctbal), 4) AS m FROM customer GROUP BY 1"),
    "g7_deviation": (_T, "/part/*::p_retailprice @| group(::p_size) | stddev | .d | rec($.p_size, 'd', ($.d | round(4)))", "SELECT p_size, round(stddev_pop(p_retailprice), 4) AS d FROM part GROUP BY 1"),
    "g8_join": (_T, "/nation/*::n_name @| group(::n_regionkey) | join('|') | .names | rec($.n_regionkey, $.names)", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1"),
    "g10_distinct": (_T, "/part/*::p_brand @| unique", "SELECT DISTINCT p_brand AS value FROM part"),
    "g10_count_distinct": (_T, "/lineitem/*::l_partkey @| unique @| count", "SELECT count(DISTINCT l_partkey) AS value FROM lineitem"),
    "g11_group": (_T, "/lineitem/* @| group(::l_returnflag, ::l_linestatus) | count | .n | %.", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "g11_group_fk": (_T, "/customer/* @| group('nation', ::c_nationkey-->::n_name) | count | .n | %.", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "g12_ungroup": (_T, "/customer/* @| group(::c_nationkey) | top(2, ::c_acctbal) @| ungroup | rec($.c_nationkey, ::c_custkey, ::c_acctbal)", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 2"),
    "g13_having": (_T, "/orders/* @| group(::o_custkey) | count | .n | [$.n > 15] | %.", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "g14_subcontext": (_T, "/nation/* | .key(::n_nationkey) | .n(^/customer/*[::c_nationkey = $$.key] @| count) | .top(^/customer/*[::c_nationkey = $$.key]::c_acctbal @| max) | rec($.key, $.n, $.top)", "SELECT n_nationkey AS key, count(c_custkey) AS n, max(c_acctbal) AS top FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "g14_theta_subcontext": (_T, "/region/* | .key(::r_regionkey) | .n(^/nation/*[::n_regionkey < $$.key] @| count) | rec($.key, $.n)", "SELECT r_regionkey AS key, (SELECT count(*) FROM nation WHERE n_regionkey < r_regionkey) AS n FROM region"),
    "g15_max_by": (_T, "/orders/* @| max_by(::o_totalprice) | rec(::o_orderkey, ::o_totalprice)", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)"),
    "g16_unique_by": (_T, "/customer/* @| unique_by(::c_nationkey) | rec(::c_nationkey, ::c_custkey)", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1"),
    "g18_pivot": (_T, "macro &pivot!($col): /data/orders/* | $col @| unique | \"| .n-${$_}(/orders/*[${$col} = '${$_}'] @| count)\"; ^ | &pivot!(::o_orderstatus) | rec('f', $.n-F, 'o', $.n-O, 'p', $.n-P)", "SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders"),
    # windows
    "w1_moving_sum": (_T, "/orders/* | .p(::o_totalprice) @| window(-2..0, ::o_custkey) | sum | rec(::o_orderkey, 's', ($_ | round(2)))", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders"),
    "w1_global_window": (_T, "/events/* | ::value @| window(-3..3) | max | rec(::event_id, 'm', $_)", "SELECT event_id, max(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM events"),
    "w3_lag": (_T, "/events/* | ::value @| shift(1, ::user_id) | rec(::event_id, 'before', $_)", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events"),
    "w3_lead_global": (_T, "/nation/* | ::n_name @| shift(-1) | rec(::n_nationkey, 'after', $_)", "SELECT n_nationkey, lead(n_name) OVER (ORDER BY n_nationkey) AS after FROM nation"),
    "w6_cumulative": (_T, "/events/* | ::value @| window(..0, ::event_type) | sum | rec(::event_id, 's', ($_ | round(2)))", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS s FROM events"),
    "w7_difference": (_T, "/events/* | ::value | .now @| shift(1, ::user_id) | rec(::event_id, 'd', ($.now - $_ | round(4)))", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS d FROM events"),
    # sorts, limits, fan-out
    "s3_top_per_key": (_T, "/part/* @| sort_by(::p_size, ::p_retailprice) @| [..10] | rec(::p_partkey, ::p_size)", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_retailprice, p_partkey LIMIT 10"),
    "s5_top": (_T, "/orders/* @| top(10, ::o_totalprice) | rec(::o_orderkey, ::o_totalprice)", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "s5_bottom": (_T, "/customer/* @| bottom(5, ::c_acctbal) | ::c_custkey", "SELECT c_custkey AS value FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5"),
    "s6_slice": (_T, "/supplier/* @| sort_by(::s_acctbal) @| [3..7] | ::s_suppkey", "SELECT s_suppkey AS value FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS n FROM supplier) WHERE n BETWEEN 3 AND 7"),
    "s9_spread": (_T, "/part/*::p_name | split(' ')", "SELECT unnest(string_split(p_name, ' ')) AS value FROM part"),
    "s10_map": (_T, "/part/* | (::p_name | split(' ')) $| upper | join('+') | rec(::p_partkey, 'u', $_)", "SELECT p_partkey, upper(replace(p_name, ' ', '+')) AS u FROM part"),
    "s1_sort_reverse": (_T, "/nation/*::n_name @| sort @| reverse @| [..3]", "SELECT n_name AS value FROM nation ORDER BY n_name DESC LIMIT 3"),
    # scalars
    "t1_strings": (_T, "/nation/* | rec(::n_nationkey, 'u', upper(::n_name), 'l', lower(::n_name), 'n', chars(::n_name))", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS n FROM nation"),
    "t3_word_count": (_T, "/documents/* | rec(::doc_id, 'n', wc(::text))", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents"),
    "t5_substitute": (_T, "/part/*::p_name | s/a(.)/<$1>/g", "SELECT regexp_replace(p_name, 'a(.)', '<\\1>', 'g') AS value FROM part"),
    "t5_substitute_first": (_T, "/part/*::p_name | s/[aeiou]/_/", "SELECT regexp_replace(p_name, '[aeiou]', '_') AS value FROM part"),
    "e1_hashes": (_T, "/nation/* | rec(::n_nationkey, 's', sha256(::n_name), 'h', hex(::n_name), 'b', base64(::n_name))", "SELECT n_nationkey, sha256(n_name) AS s, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b FROM nation"),
    "e5_round_trips": (_T, "/nation/* | rec(::n_nationkey, 'a', (::n_name | base64 | decode(base64)), 'b', (::n_name | base64url | decode(base64url)), 'c', (::n_name | base32 | decode(base32)), 'd', (::n_name | crockford32 | decode(crockford32)), 'e', (::n_name | hex | decode(hex)))", "SELECT n_nationkey, n_name AS a, n_name AS b, n_name AS c, n_name AS d, n_name AS e FROM nation"),
    "h1_rounding": (_T, "/customer/* | rec(::c_custkey, 'r', round(::c_acctbal), 'f', floor(::c_acctbal), 'c', ceil(::c_acctbal), 'a', abs(::c_acctbal))", "SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, abs(c_acctbal) AS a FROM customer"),
    "c4_date_parts": (_T, "/orders/* | rec(::o_orderkey, 'y', year(::o_orderdate), 'm', month(::o_orderdate), 'd', day(::o_orderdate), 'w', weekday(::o_orderdate), 'k', isoweek(::o_orderdate), 'i', isodate(::o_orderdate))", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS w, strftime(o_orderdate, '%G-W%V') AS k, strftime(o_orderdate, '%Y-%m-%d') AS i FROM orders"),
    "c8_strftime": (_T, "/events/* | rec(::event_id, 's', (::ts | strftime('%d/%m/%Y %H:%M')))", "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS s FROM events"),
    "c2_event_buckets": (_T, "/events/* @| group('day', isodate(::ts), ::event_type) | count | .n | %.", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "c11_durations": (_T, "/events/* | rec(::event_id, 'later', epoch(::ts + 1d2h) - epoch(::ts))", "SELECT event_id, CAST(93600 AS BIGINT) AS later FROM events"),
    # benchmark shapes
    "sum_by_status": (_T, "/lineitem/*[::l_shipdate <= 1998-09-02] | ::l_quantity @| group(::l_returnflag, ::l_linestatus) | sum | .qty | rec($.l_returnflag, $.l_linestatus, 'qty', ($.qty | round(2)))", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "revenue_top_orders": (_T, "/lineitem/*[::l_orderkey-->::o_custkey-->::c_mktsegment = 'BUILDING'] | ::l_extendedprice * (1 - ::l_discount) @| group(::l_orderkey) | sum | .rev @| top(10, $.rev) | rec($.l_orderkey, 'rev', ($.rev | round(2)))", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC LIMIT 10"),
    "revenue_by_nation": (_T, "/lineitem/* | ::l_extendedprice * (1 - ::l_discount) @| group('nation', ::l_orderkey-->::o_custkey-->::c_nationkey-->::n_name) | sum | .rev | rec($.nation, 'rev', ($.rev | round(0)))", "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 0) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "lines_by_priority": (_T, "/lineitem/* @| group('priority', ::l_orderkey-->::o_orderpriority) | count | .n | %.", "SELECT o_orderpriority AS priority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "promotion_revenue": (_T, "/lineitem/* | (::l_partkey-->::p_type = 'PROMO' ? ::l_extendedprice : 0) @| sum | round(0)", "SELECT round(sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice ELSE 0 END), 0) AS value FROM lineitem JOIN part ON l_partkey = p_partkey"),
    # trees
    "n2_descendants": ("geography", "//*<customer>[::balance > 9000] | rec(:::name, ::balance)", "SELECT c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance FROM customer WHERE c_acctbal > 9000"),
    "n1_tree_children": ("geography", "/ASIA/* | :::name", "SELECT n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "n4_parent": ("geography", "//*<customer>[::balance > 9900]\\* | :::name", "SELECT DISTINCT n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900"),
    "n3_distal": ("geography", "/EUROPE//!* @| count", "SELECT count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"),
    "n6_next_sibling": ("geography", "//*<nation>[:::index = 1]>* | :::name", "SELECT n_name AS value FROM (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i = 2"),
    "n7_preceding": ("geography", "//*<nation>[:::is-last-child]<<* | :::name", "SELECT n_name AS value FROM (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS i FROM nation) WHERE i > 1"),
    "n18_leaves": ("geography", "//*$ @| count", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS value"),
    "m3_regex_name": ("geography", "/*/~(^NATION_1) | :::name", "SELECT n_name AS value FROM nation WHERE regexp_matches(n_name, '^NATION_1')"),
    "m2_glob_name": ("geography", "/A*/* @| count", "SELECT count(*) AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'"),
    "n8_links": ("geography", "//*<nation>->next | rec(:::name, 'via', $-::region)", "SELECT name, via FROM (SELECT lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS name, r_name AS via FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE name IS NOT NULL"),
    "n9_back_links": ("geography", "//*<nation><-next | :::name", "SELECT value FROM (SELECT n_name AS value, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL"),
    "j6_counts": ("geography", "/*/* | rec(:::name, 'n', :::n-children, 'd', :::depth, 's', :::n-siblings)", "SELECT n_name AS name, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS INT) AS n, 2 AS d, count(*) OVER (PARTITION BY n_regionkey) - 1 AS s FROM nation"),
    "f7_tree_exists": ("geography", "/*/*[/*[::balance > 9900]] | :::name", "SELECT n_name AS value FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    "f2_tree_position": ("geography", "/*/*[1] | :::name", "SELECT n_name AS value FROM (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i = 1"),
    "p2_reply_chain": ("replies", "/*/0(->reply)+ @| count", "SELECT count(*) AS value FROM conversations WHERE turn > 0"),
    "p2_exact_hops": ("replies", "/*/0(->reply){2} | rec(::conv, 'turn', :::name)", "SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS VARCHAR) AS turn FROM conversations WHERE turn = 2"),
    "p6_shortest": ("replies", "/*/0(->reply)+[::role = 'user']? | rec(::conv, 'turn', :::name)", "SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(min(turn) AS VARCHAR) AS turn FROM conversations WHERE turn > 0 AND role = 'user' GROUP BY conv_id"),
    "html_links": ("pages", "//a<link>[::href] @| group(:::depth) | count | .n | %.", None),
    "html_titles": ("pages", "/*//title | rec('page', :::name-path, 'title', ::)", None),
    "json_props": ("event_props", "/*[::k > 90] | rec(:::name, ::k)", "SELECT CAST(event_id AS VARCHAR) AS name, json_extract_string(props, '$.k') AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90"),
    # one behaviour each
    "g4_min_max": (_T, "/part/* | ::p_retailprice @| group(::p_brand) | max | .m | rec($.p_brand, $.m)", "SELECT p_brand, max(p_retailprice) AS m FROM part GROUP BY 1"),
    "g4_min": (_T, "/orders/* | ::o_totalprice @| group(::o_orderpriority) | min | .m | rec($.o_orderpriority, $.m)", "SELECT o_orderpriority, min(o_totalprice) AS m FROM orders GROUP BY 1"),
    "g3_product": (_T, "/nation/* | ::n_nationkey + 1 @| group(::n_regionkey) | product | .p | rec($.n_regionkey, $.p)", "SELECT n_regionkey, product(n_nationkey + 1) AS p FROM nation GROUP BY 1"),
    "g7_variance": (_T, "/part/*::p_retailprice @| group(::p_size) | variance | .d | rec($.p_size, 'd', ($.d | round(0)))", "SELECT p_size, round(var_pop(p_retailprice), 0) AS d FROM part GROUP BY 1"),
    "g9_first_last": (_T, "/orders/* | ::o_totalprice @| group(::o_custkey) | first | .a | rec($.o_custkey, $.a)", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS a FROM orders GROUP BY 1"),
    "g9_last": (_T, "/orders/* | ::o_totalprice @| group(::o_custkey) | last | .a | rec($.o_custkey, $.a)", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS a FROM orders GROUP BY 1"),
    "w2_trailing_window": (_T, "/events/* | ::value @| window(3) | sum | rec(::event_id, 's', ($_ | round(3)))", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS s FROM events"),
    "w6_cumulative_all": (_T, "/nation/* | ::n_regionkey @| window(..0) | sum | rec(::n_nationkey, 's', $_)", "SELECT n_nationkey, CAST(sum(n_regionkey) OVER (ORDER BY n_nationkey) AS BIGINT) AS s FROM nation"),
    "a2_division": (_T, "/orders/* | rec(::o_orderkey, 'd', (::o_totalprice div (::o_orderkey mod 3)))", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / (o_orderkey % 3) END AS d FROM orders"),
    "a3_negative_division": (_T, "/customer/* | rec(::c_custkey, 'q', (-::c_custkey idiv 7), 'm', (-::c_custkey mod 7))", "SELECT c_custkey, -c_custkey // 7 AS q, -c_custkey % 7 AS m FROM customer"),
    "a5_unary_minus": (_T, "/supplier/* | rec(::s_suppkey, 'n', -::s_acctbal)", "SELECT s_suppkey, -s_acctbal AS n FROM supplier"),
    "c1_datetime": (_T, '/nation/* | rec(::n_nationkey, \'e\', ("2024-03-1${::n_regionkey}T06:00:00Z" | datetime | epoch))', "SELECT n_nationkey, CAST(epoch(TIMESTAMP '2024-03-10 06:00:00') + 86400 * n_regionkey AS BIGINT) AS e FROM nation"),
    "c3_isoformat": (_T, "/orders/* | rec(::o_orderkey, 's', (::o_orderdate | isoformat))", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders"),
    "c4_time_parts": (_T, "/events/* | rec(::event_id, 'h', hour(::ts), 'm', minute(::ts), 's', second(::ts))", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts) AS s FROM events"),
    "c5_isomonth": (_T, "/orders/* @| group('month', isomonth(::o_orderdate)) | count | .n | %.", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1"),
    "c7_date": (_T, "/events/* | rec(::event_id, 'd', (::ts | date | isodate))", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events"),
    "c9_strptime": (_T, "/orders/* | rec(::o_orderkey, 'e', (::o_orderdate | strftime('%d.%m.%Y') | strptime('%d.%m.%Y') | epoch))", "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS e FROM orders"),
    "c10_number_to_duration": (_T, "/events/* | rec(::event_id, 'e', epoch(::ts + (::event_id mod 50 | hours)) - epoch(::ts))", "SELECT event_id, CAST(3600 * (event_id % 50) AS BIGINT) AS e FROM events"),
    "c11_duration_text": (_T, '/part/* | rec(::p_partkey, \'d\', epoch(1970-01-01 + ("${::p_size}h30min" | duration)))', "SELECT p_partkey, CAST(3600 * p_size + 1800 AS BIGINT) AS d FROM part"),
    "c12_now": (_T, "/orders/* | rec(::o_orderkey, 'd', (epoch(now()) - epoch(::o_orderdate)))", "SELECT o_orderkey, CAST(epoch(TIMESTAMP '2024-01-01') - epoch(o_orderdate) AS BIGINT) AS d FROM orders"),
    "q2_quantities": (_T, "/part/* | rec(::p_partkey, 'cm', ((\"${::p_size} in\" | quantity | convert(cm) | s/[^0-9.]//g) * 100 | round))", "SELECT p_partkey, CAST(round(p_size * 254) AS BIGINT) AS cm FROM part"),
    "q1_quantity_order": (_T, '/part/*[("${::p_size}cm" | quantity) > 20cm] @| count', "SELECT count(*) AS value FROM part WHERE p_size > 20"),
    "t6_default": (_T, "/orders/* | rec(::o_orderkey, 'd', (::o_orderkey div (::o_orderkey mod 2) | default(-1)))", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_orderkey AS DOUBLE) ELSE -1 END AS d FROM orders"),
    "t1_trim": (_T, '/nation/* | rec(::n_nationkey, \'t\', ("  ${::n_name} " | trim))', "SELECT n_nationkey, n_name AS t FROM nation"),
    "t4_words": (_T, "/part/* | rec(::p_partkey, 'w', (::p_name | words | join('_')), 'l', (::p_name | lines | count))", "SELECT p_partkey, replace(p_name, ' ', '_') AS w, 1 AS l FROM part"),
    "n14_mark": (_T, "/orders/*[::o_totalprice > 300000] @| [..50] | .who(::o_custkey-->::c_name) | rec(::o_orderkey, $.who)", "SELECT o_orderkey, c_name AS who FROM (SELECT * FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 50) JOIN customer ON c_custkey = o_custkey"),
    "p8_star": ("replies", "/*/0(->reply)* @| count", "SELECT count(*) AS value FROM conversations"),
    "p4_bounded": ("replies", "/*/0(->reply){1,3} @| count", "SELECT count(*) AS value FROM conversations WHERE turn BETWEEN 1 AND 3"),
    "p9_nested": ("replies", "/*/0((->reply){2})+ @| count", "SELECT count(*) AS value FROM conversations WHERE turn > 0 AND turn % 2 = 0"),
    "p7_breadcrumbs": ("replies", "/*/0(->reply .hop(::role))+ | rec(::conv, 'turn', :::name, 'path', ($.hop | join('>')))", "SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS VARCHAR) AS turn, (SELECT string_agg(b.role, '>' ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn BETWEEN 1 AND a.turn) AS path FROM conversations a WHERE turn > 0"),
    "n5_ancestor": ("geography", '//*<customer>[::balance > 0]\\\\*<region> | :::name', "SELECT DISTINCT r_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0"),
    "n5_proximal": ("geography", '//*<customer>\\\\?* | :::name', "SELECT DISTINCT n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "n6_previous_sibling": ("geography", "//*<nation>[:::index = 3]<* | :::name", "SELECT n_name AS value FROM (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i = 2 AND n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 2)"),
    "n7_following": ("geography", "//*<nation>[:::is-first-child]>>* | :::name", "SELECT n_name AS value FROM (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i > 1"),
    "n10_either_direction": ("geography", "//*<nation>--next | :::name", "SELECT DISTINCT n_name AS value FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1)"),
    "j5_parent": ("geography", "//*<nation> | rec(:::name, 'p', :::parent-name)", "SELECT n_name AS name, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "j6_descendants": ("geography", "/* | rec(:::name, 'n', :::n-descendants)", "SELECT r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n FROM region"),
    "j8_node_kinds": ("geography", "//*[:::is-leaf or :::is-top-level] @| count", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS value"),
    "j9_name_path": ("geography", "/*/* | :::name-path", "SELECT '/' || r_name || '/' || n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "j7_traits": ("geography", "//*<nation> | rec(:::name, 't', (:::traits | join(',')))", "SELECT n_name AS name, 'nation' AS t FROM nation"),
    "d1_json": (_T, "/events/* | .j(::props | decode(json) | json) | [$.j =~ /:9[1-9]/] | rec(::event_id, 'k', $.j)", "SELECT event_id, replace(props, ' ', '') AS k FROM events WHERE regexp_matches(replace(props, ' ', ''), ':9[1-9]')"),
    "d4_json": (_T, "/nation/* | rec(::n_nationkey, 'j', (rec(::n_name, ::n_regionkey) | json))", 'SELECT n_nationkey, \'{"n_name": "\' || n_name || \'", "n_regionkey": \' || n_regionkey || \'}\' AS j FROM nation'),
    "k4_left_outer": (_T, "/customer/* <=>? /orders/*[::o_custkey = $$::c_custkey and ::o_totalprice > 250000] | rec(::c_custkey, 'first', $*1::o_orderkey)", "SELECT c_custkey, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY c_custkey"),
    "k5_left_anti": (_T, "/customer/* <=>? /orders/*[::o_custkey = $$::c_custkey and ::o_totalprice > 250000] | [$*1::o_orderkey = null] | ::c_custkey", "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "k10_outer_fan_out": (_T, "/region/* | rec(::r_name, 'n', (<-n_regionkey::n_name @| count))", "SELECT r_name, count(n_name) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "f7_not_exists": (_T, "/nation/*[not <-s_nationkey[::s_acctbal > 9000]] | ::n_name", "SELECT n_name AS value FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)"),
    "w4_null_keys": (_T, "/events/* | ::value @| shift(1, (::event_id mod 3 = 0 ? null : ::user_id)) | rec(::event_id, 'b', $_)", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN lag(value) OVER (PARTITION BY CASE WHEN event_id % 3 <> 0 THEN user_id END ORDER BY event_id) END AS b FROM events"),
    "tpch_q6": (_T, "/lineitem/*[::l_shipdate >= 1994-01-01 and ::l_shipdate < 1995-01-01 and ::l_discount >= 0.05 and ::l_discount <= 0.07 and ::l_quantity < 24] | ::l_extendedprice * ::l_discount @| sum | round(2)", "SELECT round(sum(l_extendedprice * l_discount), 2) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24"),
}


def _source(name: str, spark, sf_dir: str):
    from .sources.model import Mount

    if name == "mount":
        return Mount({"db": catalog.tables(spark, sf_dir), "crm": catalog.tables(spark, sf_dir)})
    return {"tables": catalog.tables, "geography": catalog.geography, "replies": catalog.replies, "pages": catalog.html_pages, "event_props": catalog.event_props}[name](spark, sf_dir)


def _query(source: str, text: str):
    return lambda spark, sf_dir: Engine(spark, _source(source, spark, sf_dir), "2024-01-01 00:00:00").query(text, ordered=False)


def queries() -> dict:
    return {name: _query(source, text) for name, (source, text, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in QUERIES.items() if sql}
