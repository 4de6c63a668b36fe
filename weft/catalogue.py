"""A query for each step, with the SQL that gives the same rows over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.sources.tables import from_tables

CATALOGUE: dict[str, tuple[str, str]] = {
    "v_scan": (
        'g.V().hasLabel("region").values("name")',
        'select r_name as value from region',
    ),
    "v_count": (
        'g.V().hasLabel("customer","supplier").count()',
        'select (select count(*) from customer)+(select count(*) from supplier) as value',
    ),
    "e_count": (
        'g.E().hasLabel("contains").count()',
        'select count(*) as value from lineitem',
    ),
    "has_eq": (
        'g.V().has("mktsegment","BUILDING").values("name")',
        "select c_name as value from customer where c_mktsegment='BUILDING'",
    ),
    "has_key": (
        'g.V().hasKey("quality").count()',
        'select count(*) as value from documents d join labels l using(doc_id)',
    ),
    "has_not": (
        'g.V().hasLabel("document").hasNot("quality").count()',
        'select count(*) as value from documents where doc_id not in (select doc_id from labels)',
    ),
    "has_value": (
        'g.V().hasValue("ECONOMY").count()',
        "select count(*) as value from part where p_type='ECONOMY'",
    ),
    "pred_eq_lte": (
        'g.V().has("brand",eq("Brand#1")).has("size",lte(25)).count()',
        "select count(*) as value from part where p_brand='Brand#1' and p_size<=25",
    ),
    "pred_neq": (
        'g.V().has("mktsegment",neq("BUILDING")).count()',
        "select count(*) as value from customer where c_mktsegment<>'BUILDING'",
    ),
    "pred_lt_gte": (
        'g.V().has("size",gte(10)).has("size",lt(20)).values("size")',
        'select p_size as value from part where p_size>=10 and p_size<20',
    ),
    "pred_inside": (
        'g.V().has("size",inside(10,20)).values("name")',
        'select p_name as value from part where p_size>10 and p_size<20',
    ),
    "pred_outside": (
        'g.V().has("size",outside(10,20)).count()',
        'select count(*) as value from part where p_size<10 or p_size>20',
    ),
    "pred_between": (
        'g.V().has("size",between(10,20)).count()',
        'select count(*) as value from part where p_size between 10 and 20',
    ),
    "pred_within": (
        'g.V().has("brand",within("Brand#1","Brand#2")).count()',
        "select count(*) as value from part where p_brand in ('Brand#1','Brand#2')",
    ),
    "pred_without": (
        'g.V().has("lang",without("en","fr")).count()',
        "select count(*) as value from documents where lang not in ('en','fr')",
    ),
    "is_step": (
        'g.V().hasLabel("part").values("size").is(gt(45))',
        'select p_size as value from part where p_size>45',
    ),
    "out_step": (
        'g.V().has("mktsegment","BUILDING").out("placed").values("status")',
        "select o_orderstatus as value from customer join orders on c_custkey=o_custkey where c_mktsegment='BUILDING'",
    ),
    "in_step": (
        'g.V().hasLabel("region").in("in_region").values("name")',
        'select n_name as value from nation',
    ),
    "both_step": (
        'g.V().hasLabel("nation").both("in_region").values("name")',
        'select r_name as value from nation join region on n_regionkey=r_regionkey',
    ),
    "out_e": (
        'g.V().hasLabel("order").outE("contains").values("returnflag").dedup()',
        'select distinct l_returnflag as value from lineitem',
    ),
    "in_e_out_v": (
        'g.V().hasLabel("part").has("size",50).inE("contains").outV().dedup().count()',
        'select count(distinct l_orderkey) as value from lineitem join part on p_partkey=l_partkey where p_size=50',
    ),
    "both_e": (
        'g.V().hasLabel("nation").bothE().count()',
        'select (select count(*) from nation)+(select count(*) from customer)+(select count(*) from supplier) as value',
    ),
    "edge_in_v": (
        'g.E().hasLabel("contains").has("quantity",gt(45.0)).inV().dedup().count()',
        'select count(distinct l_partkey) as value from lineitem where l_quantity>45',
    ),
    "both_v": (
        'g.E().hasLabel("in_region").bothV().dedup().count()',
        'select (select count(*) from nation)+(select count(distinct n_regionkey) from nation) as value',
    ),
    "two_hop": (
        'g.V().hasLabel("customer").out("placed").out("contains").count()',
        'select count(*) as value from orders join lineitem on o_orderkey=l_orderkey',
    ),
    "values_two_labels": (
        'g.V().hasLabel("nation","region").values("name")',
        'select n_name as value from nation union all select r_name from region',
    ),
    "properties_step": (
        'g.V().hasLabel("region").properties("name")',
        "select concat('{name:',r_name,'}') as value from region",
    ),
    "key_step": (
        'g.V().hasLabel("supplier").key().dedup()',
        "select unnest(['name','acctbal']) as value",
    ),
    "label_step": (
        'g.V().hasLabel("customer").both().label().dedup()',
        "select unnest(['nation','order','event']) as value",
    ),
    "as_select": (
        'g.V().hasLabel("nation").as("n").out("in_region").select("n").values("name")',
        'select n_name as value from nation',
    ),
    "select_multi": (
        'g.V().hasLabel("nation").as("a").out("in_region").as("b").select("a","b")',
        'select cast(n_nationkey as bigint)*16+2 as a, cast(n_regionkey as bigint)*16+1 as b from nation',
    ),
    "where_neq": (
        'g.V().hasLabel("nation").as("a").out("in_region").in("in_region").where(neq("a")).values("name")',
        'select y.n_name as value from nation x join nation y on x.n_regionkey=y.n_regionkey where x.n_nationkey<>y.n_nationkey',
    ),
    "where_two_labels": (
        'g.V().hasLabel("nation").as("a").out("in_region").in("in_region").as("b").where("a",neq("b")).count()',
        'select count(*) as value from nation x join nation y on x.n_regionkey=y.n_regionkey where x.n_nationkey<>y.n_nationkey',
    ),
    "where_within": (
        'g.V().has("mktsegment","BUILDING").out("in_nation").aggregate("x").in("in_nation").hasLabel("supplier").out("in_nation").where(within("x")).dedup().count()',
        "select count(distinct s_nationkey) as value from supplier where s_nationkey in (select c_nationkey from customer where c_mktsegment='BUILDING')",
    ),
    "where_without": (
        'g.V().has("size",50).in("contains").aggregate("x").out("contains").in("contains").where(without("x")).dedup().count()',
        'with x as (select distinct l_orderkey k from lineitem join part on p_partkey=l_partkey where p_size=50), p as (select distinct l_partkey from lineitem where l_orderkey in (select k from x)) select count(distinct l_orderkey) as value from lineitem where l_partkey in (select l_partkey from p) and l_orderkey not in (select k from x)',
    ),
    "where_sub": (
        'g.V().hasLabel("customer").where(out("placed").has("status","F")).count()',
        "select count(*) as value from customer where exists (select 1 from orders where o_custkey=c_custkey and o_orderstatus='F')",
    ),
    "where_count": (
        'g.V().hasLabel("customer").where(out("placed").count().is(gt(12))).values("name")',
        'select c_name as value from customer where (select count(*) from orders where o_custkey=c_custkey)>12',
    ),
    "where_count_zero": (
        'g.V().hasLabel("customer").where(out("did").count().is(0)).count()',
        'select count(*) as value from customer where (select count(*) from events where user_id=c_custkey)=0',
    ),
    "and_step": (
        'g.V().hasLabel("order").and(outE("contains").has("returnflag","R"),outE("contains").has("returnflag","A")).count()',
        "select count(*) as value from (select l_orderkey from lineitem where l_returnflag='R' intersect select l_orderkey from lineitem where l_returnflag='A')",
    ),
    "or_step": (
        'g.V().hasLabel("order").or(has("status","F"),outE("contains").has("quantity",gt(49.0))).count()',
        "select count(*) as value from orders where o_orderstatus='F' or o_orderkey in (select l_orderkey from lineitem where l_quantity>49)",
    ),
    "not_step": (
        'g.V().hasLabel("customer").not(out("did")).count()',
        'select count(*) as value from customer where c_custkey not in (select user_id from events)',
    ),
    "union_step": (
        'g.V().hasLabel("nation").union(out("in_region"),in("in_nation")).label().groupCount()',
        "select 'region' as key, count(*) as count from nation union all select 'customer', count(*) from customer union all select 'supplier', count(*) from supplier",
    ),
    "repeat_step": (
        'g.V().hasLabel("nation").repeat(out("in_region")).values("name")',
        'select r_name as value from nation join region on n_regionkey=r_regionkey',
    ),
    "math_max": (
        'g.V().hasLabel("part").values("size").max()',
        'select cast(max(p_size) as double) as value from part',
    ),
    "math_min": (
        'g.V().hasLabel("part").values("size").min()',
        'select cast(min(p_size) as double) as value from part',
    ),
    "math_sum": (
        'g.V().hasLabel("part").values("size").sum()',
        'select cast(sum(p_size) as double) as value from part',
    ),
    "math_mean": (
        'g.V().hasLabel("part").values("size").mean()',
        'select avg(p_size) as value from part',
    ),
    "group_step": (
        'g.V().hasLabel("nation").group("name",label)',
        "select n_name as key, ['nation'] as values from nation",
    ),
    "group_count": (
        'g.V().hasLabel("customer").groupCount("mktsegment")',
        'select c_mktsegment as key, count(*) as count from customer group by 1',
    ),
    "dedup_step": (
        'g.V().hasLabel("part").values("brand").dedup()',
        'select distinct p_brand as value from part',
    ),
    "dedup_labels": (
        'g.V().hasLabel("customer").as("c").out("placed").values("status").as("s").dedup("c","s").count()',
        'select count(*) as value from (select distinct o_custkey,o_orderstatus from orders)',
    ),
    "cap_step": (
        'g.V().hasLabel("region").values("name").aggregate("x").cap("x")',
        "select 'x' as key, list(r_name order by r_name) as values from region",
    ),
    "order_limit": (
        'g.V().hasLabel("part").values("size").order(decr).limit(5)',
        'select p_size as value from part order by p_size desc limit 5',
    ),
    "order_key": (
        'g.V().hasLabel("customer").order("name",incr).limit(10).values("name")',
        'select c_name as value from customer order by c_name limit 10',
    ),
    "range_step": (
        'g.V().hasLabel("customer").values("name").order(incr).range(10,19)',
        'select c_name as value from customer order by c_name limit 10 offset 10',
    ),
    "skip_step": (
        'g.V().hasLabel("nation").values("name").order(incr).skip(20)',
        'select n_name as value from nation order by n_name offset 20',
    ),
    "coin_all": (
        'g.V().hasLabel("customer").coin(1.0).count()',
        'select count(*) as value from customer',
    ),
    "coin_none": (
        'g.V().hasLabel("customer").coin(0.0).count()',
        'select 0 as value',
    ),
    "in_e": (
        'g.V().hasLabel("part").has("size",50).inE("contains").values("quantity")',
        'select l_quantity as value from lineitem join part on p_partkey=l_partkey where p_size=50',
    ),
    "edge_out_v": (
        'g.E().hasLabel("in_region").outV().values("name")',
        'select n_name as value from nation',
    ),
    "edge_properties": (
        'g.E().hasLabel("contains").has("quantity",gt(49.0)).properties("returnflag")',
        "select concat('{returnflag:',l_returnflag,'}') as value from lineitem where l_quantity>49",
    ),
    "edge_group_count": (
        'g.E().hasLabel("contains").has("quantity",lte(10.0)).values("returnflag").groupCount()',
        'select l_returnflag as key, count(*) as count from lineitem where l_quantity<=10 group by 1',
    ),
    "label_after_expand": (
        'g.V().hasLabel("nation").in("in_nation").hasLabel("supplier").count()',
        'select count(*) as value from supplier join nation on s_nationkey=n_nationkey',
    ),
    "group_values": (
        'g.V().hasLabel("customer").group("mktsegment","name")',
        'select c_mktsegment as key, list(c_name order by c_name) as values from customer group by 1',
    ),
    "where_order_of_labels": (
        'g.V().hasLabel("nation").as("a").out("in_region").in("in_region").as("b").where("b",gt("a")).count()',
        'select count(*) as value from nation x join nation y on x.n_regionkey=y.n_regionkey where y.n_nationkey>x.n_nationkey',
    ),
    "where_nested": (
        'g.V().hasLabel("customer").where(out("placed").where(outE("contains").has("quantity",gt(49.0)))).count()',
        'select count(*) as value from customer where exists (select 1 from orders join lineitem on l_orderkey=o_orderkey where o_custkey=c_custkey and l_quantity>49)',
    ),
    "where_max": (
        'g.V().hasLabel("nation").where(in("in_nation").hasLabel("customer").values("acctbal").max().is(gt(9900.0))).values("name")',
        'select n_name as value from nation where (select max(c_acctbal) from customer where c_nationkey=n_nationkey)>9900',
    ),
    "where_distinct_count": (
        'g.V().hasLabel("customer").where(out("did").values("etype").dedup().count().is(gt(3))).count()',
        'select count(*) as value from customer where (select count(distinct event_type) from events where user_id=c_custkey)>3',
    ),
    "union_dedup": (
        'g.V().hasLabel("nation").union(out("in_region"),in("in_nation")).dedup().count()',
        'select (select count(distinct n_regionkey) from nation)+(select count(*) from customer)+(select count(*) from supplier) as value',
    ),
    "values_two_keys": (
        'g.V().hasLabel("document").values("lang","source")',
        'select lang as value from documents where lang is not null union all select source from documents where source is not null',
    ),
    "values_all_keys": (
        'g.V().hasLabel("region","nation").values()',
        'select n_name as value from nation union all select r_name from region',
    ),
    "has_one_argument": (
        'g.V().has("brand").count()',
        'select count(*) as value from part where p_brand is not null',
    ),
    "where_lt": (
        'g.V().hasLabel("nation").as("a").out("in_region").in("in_region").where(lt("a")).count()',
        'select count(*) as value from nation x join nation y on x.n_regionkey=y.n_regionkey where y.n_nationkey<x.n_nationkey',
    ),
    "where_lte": (
        'g.V().hasLabel("nation").as("a").out("in_region").in("in_region").where(lte("a")).count()',
        'select count(*) as value from nation x join nation y on x.n_regionkey=y.n_regionkey where y.n_nationkey<=x.n_nationkey',
    ),
    "where_gte": (
        'g.V().hasLabel("nation").as("a").out("in_region").in("in_region").as("b").where("b",gte("a")).count()',
        'select count(*) as value from nation x join nation y on x.n_regionkey=y.n_regionkey where y.n_nationkey>=x.n_nationkey',
    ),
    "where_eq_triangle": (
        'g.V().hasLabel("customer").as("a").out("placed").in("placed").where(eq("a")).count()',
        'select count(*) as value from orders join customer on c_custkey=o_custkey',
    ),
    "where_between_labels": (
        'g.V().hasLabel("customer").values("acctbal").as("a").is(gt(9000.0)).as("b").where(between("a","b")).count()',
        'select count(*) as value from customer where c_acctbal>9000',
    ),
    "where_inside_labels": (
        'g.V().hasLabel("region").as("a").in("in_region").as("b").in("in_nation").hasLabel("customer").as("c").where("b",inside("a","c")).count()',
        'select count(*) as value from nation join customer on c_nationkey=n_nationkey where n_nationkey*16+2>n_regionkey*16+1 and n_nationkey*16+2<c_custkey*16+3',
    ),
    "where_outside_labels": (
        'g.V().hasLabel("region").as("a").in("in_region").as("b").in("in_nation").hasLabel("customer").as("c").where("b",outside("a","c")).count()',
        'select count(*) as value from nation join customer on c_nationkey=n_nationkey where n_nationkey*16+2<n_regionkey*16+1 or n_nationkey*16+2>c_custkey*16+3',
    ),
    "branch_limit": (
        'g.V().hasLabel("customer").where(out("placed").limit(3).count().is(3)).count()',
        'select count(*) as value from customer where (select count(*) from orders where o_custkey=c_custkey)>=3',
    ),
    "branch_order_range": (
        'g.V().hasLabel("customer").where(out("placed").values("totalprice").order(decr).range(1,1).is(gt(300000.0))).count()',
        'select count(*) as value from (select o_totalprice p, row_number() over (partition by o_custkey order by o_totalprice desc) r from orders join customer on c_custkey=o_custkey) where r=2 and p>300000',
    ),
    "branch_sum": (
        'g.V().hasLabel("order").where(outE("contains").values("quantity").sum().is(gt(150.0))).count()',
        'select count(*) as value from orders where (select sum(l_quantity) from lineitem where l_orderkey=o_orderkey)>150',
    ),
    "branch_mean": (
        'g.V().hasLabel("order").where(outE("contains").values("quantity").mean().is(gt(40.0))).count()',
        'select count(*) as value from orders where (select avg(l_quantity) from lineitem where l_orderkey=o_orderkey)>40',
    ),
    "order_by_label": (
        'g.V().hasLabel("nation","region").order(label,decr).limit(5).values("name")',
        'select r_name as value from region',
    ),
    "group_count_two_keys": (
        'g.V().hasLabel("customer").groupCount("mktsegment","name")',
        'select c_mktsegment as key, count(*) as count from customer where c_name is not null group by 1',
    ),
    "has_key_edge": (
        'g.E().hasLabel("contains").hasKey("discount").count()',
        'select count(*) as value from lineitem where l_discount is not null',
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def one(text: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: from_tables(spark, sf_dir).traverse(text)

    return {name: one(text) for name, (text, _) in CATALOGUE.items()}


def sql() -> dict[str, str]:
    return {name: q for name, (_, q) in CATALOGUE.items()}
