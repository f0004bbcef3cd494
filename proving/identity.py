"""Cases: identity resolution and the org tree."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from proving.case import case
from proving.given import Given
from workmart.operators import identity, matching, tree
from workmart.operators.reshape import union_all

_UUID = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_SPARK_UUID = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"


class People:
    """Accounts, observations and edges made from customers and orders."""

    def __init__(self, g: Given) -> None:
        self.g = g

    @cached_property
    def inputs(self) -> DataFrame:
        hr = ("'t1' as tenant_id", "'hr' as source_type", "'s1' as source_id", "cast(c_custkey as string) as source_account_id")
        chat = ("'t1' as tenant_id", "'chat' as source_type", "'s2' as source_id", "concat('x', c_custkey) as source_account_id")
        at = lambda d: f"timestamp'2024-0{d}-01 00:00:00' as _synced_at"
        c = self.g.customer
        mailed = c.filter("c_nationkey not in (3, 13)")
        return union_all([
            mailed.selectExpr(*hr, "'email' as value_type", "'old@x' as value", "'UPSERT' as operation_type", at(1)),
            mailed.selectExpr(*hr, "'email' as value_type", "c_name as value", "'UPSERT' as operation_type", at(2)),
            c.selectExpr(*hr, "'display_name' as value_type", "case when c_custkey = 1 then repeat('long', 200) else concat('Name ', c_custkey) end as value", "'UPSERT' as operation_type", at(1)),
            c.filter("c_acctbal < 0").selectExpr(*hr, "'email' as value_type", "'' as value", "'DELETE' as operation_type", at(3)),
            c.filter("c_nationkey % 2 = 0").selectExpr(*chat, "'email' as value_type", "upper(c_name) as value", "'UPSERT' as operation_type", at(2))])

    @cached_property
    def known(self) -> DataFrame:
        both = "timestamp'2023-01-01 00:00:00' as created_at"
        c = self.g.customer
        ids = c.filter("c_nationkey < 5").selectExpr("cast(c_custkey as bigint) as id", "'id' as value_type", "'hr' as source_type", "'s1' as source_id", "'t1' as tenant_id",
                                                     "cast(c_custkey as string) as value_id", "concat('P', c_custkey) as person_id", both)
        mails = c.filter("c_nationkey between 5 and 9").selectExpr("cast(c_custkey as bigint) as id", "'email' as value_type", "'hr' as source_type", "'s1' as source_id",
                                                                   "'t1' as tenant_id", "lower(c_name) as value_id", "concat('P', c_custkey) as person_id", both)
        return ids.unionByName(mails)

    @cached_property
    def assigned(self) -> DataFrame:
        return identity.resolve_persons(identity.account_profiles(self.inputs), self.known)

    @cached_property
    def bindings(self) -> DataFrame:
        return self.g.orders.selectExpr(
            "o_orderkey as id", "'id' as value_type", "'hr' as source_type", "'s1' as source_id", "'t1' as tenant_id", "cast(o_custkey as string) as value_id",
            "concat('P', o_orderkey % 7) as person_id", "'me' as author_person_id", "'' as reason", "o_orderdate as created_at")

    @cached_property
    def observed(self) -> DataFrame:
        """Members with e-mails, changing status and parents."""
        base = ("'t1' as tenant_id", "'hr' as source_type", "'s1' as source_id", "'me' as author_person_id", "'' as reason")
        person = lambda key: _SPARK_UUID.format(f"concat('p', {key})") + " as person_id"
        name = lambda key: f"concat('Customer#', lpad(cast({key} as string), 9, '0'))"
        row = lambda df, kind, key, value_id, text, at, i: df.selectExpr(
            *base, f"'{kind}' as value_type", person(key), f"{value_id} as value_id", f"{text} as value_full_text", f"{at} as created_at", f"cast({i} as bigint) as id")
        none = "cast(null as string)"
        c, o = self.g.customer, self.g.orders
        rows = union_all([
            row(c, "email", "c_custkey", "c_name", none, "timestamp'1995-01-01 00:00:00'", "c_custkey"),
            row(c, "display_name", "c_custkey", none, "concat('Last', c_custkey, ', First')", "timestamp'1995-01-01 00:00:00'", "c_custkey"),
            row(o, "status", "o_custkey", none, "case when o_orderstatus = 'O' then 'Inactive' else 'Active' end", "o_orderdate", "o_orderkey"),
            row(c.filter("c_custkey > 0"), "parent_email", "c_custkey", name("(c_custkey - 1) div 4"), none, "timestamp'1996-01-01 00:00:00'", "c_custkey"),
            row(c.filter("c_nationkey < 9"), "parent_email", "c_custkey", name("c_custkey div 8"), none, "timestamp'1999-01-01 00:00:00'", "c_custkey"),
            row(c.filter("c_nationkey = 20"), "parent_person_id", "c_custkey", _SPARK_UUID.format("concat('p', c_custkey div 2)"), none, "timestamp'1997-01-01 00:00:00'", "c_custkey")])
        return rows.withColumn("value_effective", F.coalesce("value_id", "value_full_text"))

    @cached_property
    def chart(self) -> DataFrame:
        """Every customer reports to the one with a quarter of its number; the
        edges of customers in debt are over."""
        return self.g.customer.selectExpr(
            "'t1' as tenant_id", "'hr' as source_type", "'s1' as source_id", "cast(c_custkey as string) as child_person_id",
            "case when c_custkey > 0 then cast((c_custkey - 1) div 4 as string) end as parent_person_id", "timestamp'2020-01-01 00:00:00' as valid_from",
            "case when c_acctbal < 0 then timestamp'2023-01-01 00:00:00' end as valid_to")

    @cached_property
    def visibility(self) -> DataFrame:
        grants = self.g.orders.join(self.g.customer.select(F.col("c_custkey").alias("o_orderkey")), "o_orderkey").selectExpr(
            "'t1' as tenant_id", "cast(o_custkey as string) as viewer_person_id", "cast(o_orderkey as string) as viewed_person_id", "o_orderdate as valid_from",
            "case when o_orderstatus = 'F' then timestamp'2010-01-01 00:00:00' end as valid_to")
        wild = self.g.customer.filter("c_custkey = 5").selectExpr(
            "'t1' as tenant_id", "'5' as viewer_person_id", "cast(null as string) as viewed_person_id", "timestamp'2020-01-01 00:00:00' as valid_from", "cast(null as timestamp) as valid_to")
        return grants.unionByName(wild)

    @cached_property
    def everyone(self) -> DataFrame:
        return self.g.customer.selectExpr("'t1' as tenant_id", "cast(c_custkey as string) as person_id")

    @cached_property
    def visible(self) -> DataFrame:
        viewers = self.everyone.withColumnRenamed("person_id", "viewer_person_id")
        return tree.visible_set(viewers, self.visibility, self.everyone, self.chart, "t1", "hr", self.g.as_of)


_PROFILES = """select 'hr' source_type, c_custkey::varchar source_account_id, case when c_nationkey not in (3, 13) then c_name end latest_email, c_acctbal < 0 is_closed, * from customer
    union all select 'chat', 'x' || c_custkey, upper(c_name), false, * from customer where c_nationkey % 2 = 0"""
_OUTCOME = f"""select source_type, source_account_id, case when c_nationkey < 5 or c_nationkey between 5 and 9 then 'P' || c_custkey when c_nationkey = 13 then null
      when c_acctbal < 0 and c_nationkey % 2 = 1 then null else {_UUID.format("'person|t1|mail|' || lower(c_name)")} end person_id,
      case when c_nationkey < 5 then 'reused_known' when c_nationkey between 5 and 9 then 'linked_by_email' when c_nationkey = 13 then 'skipped_no_email'
      when c_acctbal < 0 and c_nationkey % 2 = 1 then 'skipped_closed' else 'minted' end outcome, c_custkey, c_name, c_nationkey from ({_PROFILES})"""

case("O1_account_profiles", "source_type:s source_account_id:s latest_email:s is_closed:b", f"select source_type, source_account_id, latest_email, is_closed from ({_PROFILES})")(
    lambda g: identity.account_profiles(People(g).inputs))
case("O2_resolve_persons", "source_type:s source_account_id:s person_id:s outcome:s", _OUTCOME)(lambda g: People(g).assigned)
case("O2_outcome_counts", "outcome:s accounts:i", f"select outcome, count(*) accounts from ({_OUTCOME}) group by 1")(lambda g: identity.resolution_counts(People(g).assigned))


@case("O3_observations", "source_type:s person_id:s value_type:s value_id:s value_full_text:s reason:s",
      f"""with o as ({_OUTCOME}), r as (select o.*, case when outcome = 'linked_by_email' then 'auto-seed-link' else '' end reason from o where person_id is not null)
          select source_type, person_id, 'email' value_type, unnest(['old@x', c_name]) value_id, null value_full_text, reason from r where source_type = 'hr' and c_nationkey <> 3
          union all select source_type, person_id, 'email', upper(c_name), null, reason from r where source_type = 'chat'
          union all select source_type, person_id, 'display_name', null, case when c_custkey = 1 then repeat('long', 200) else 'Name ' || c_custkey end, reason from r where source_type = 'hr'""")
def o3(g: Given):
    p = People(g)
    return identity.observations(p.inputs, p.assigned, "me")


case("O4_account_person_map", "source_account_id:s person_id:s valid_from:t valid_to:t",
     """select o_custkey source_account_id, 'P' || (o_orderkey % 7) person_id, o_orderdate valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) valid_to from orders""")(
    lambda g: identity.account_person_map(People(g).bindings))

_P = lambda key: _UUID.format(f"'p' || ({key})")
_ORG = f"""with log as (select o_custkey c, o_orderdate at_, o_orderkey id, o_orderstatus <> 'O' on_ from orders),
    changes as (select * from (select *, lag(on_) over (partition by c order by at_, id) was from log) where was is null or was <> on_),
    spans as (select c, at_ s, e from (select *, lead(at_) over (partition by c order by at_, id) e from changes) where on_),
    mailed as (select c_custkey c, (c_custkey - 1) // 4 parent, timestamp '1996-01-01' at_ from customer where c_custkey > 0 union all select c_custkey, c_custkey // 8, timestamp '1999-01-01' from customer where c_nationkey < 9),
    active as (select * from spans union all select distinct c, timestamp '1970-01-01', null::timestamp from mailed where c not in (select c from log)),
    periods as (select *, lead(at_) over (partition by c order by at_) pe from mailed),
    edges as (
      select c_custkey c, c_custkey // 2 parent, timestamp '1997-01-01' f, null::timestamp t from customer where c_nationkey = 20 and c_custkey // 2 <> c_custkey
      union all select p.c, p.parent, greatest(p.at_, a.s), case when p.pe is null then a.e when a.e is null then p.pe else least(p.pe, a.e) end from periods p join active a using (c)
        where p.parent <> p.c and p.c not in (select c_custkey from customer where c_nationkey = 20) and a.s < coalesce(p.pe, timestamp '9999-12-31') and coalesce(a.e, timestamp '9999-12-31') > p.at_),
    alone as (select c_custkey c, null::bigint parent, timestamp '1995-01-01' f, l.e t from customer left join (select * from spans qualify row_number() over (partition by c order by s desc) = 1) l on l.c = c_custkey
      where c_custkey not in (select c from edges) and (c_custkey not in (select c from log) or l.c is not null))
    select {_P('c')} child_person_id, case when parent is not null then {_P('parent')} end parent_person_id, f valid_from, t valid_to from (select * from edges union all select * from alone)"""
case("O5_org_chart", "child_person_id:s parent_person_id:s valid_from:t valid_to:t", _ORG)(lambda g: identity.org_chart(People(g).observed, "me"))

_EDGES = "select c_custkey c, case when c_custkey > 0 then (c_custkey - 1) // 4 end p from customer where c_acctbal >= 0"
_SUB = f"""with recursive e as ({_EDGES}), t as (select 0::bigint person, null::bigint parent, 0 depth union all select e.c, e.p, depth + 1 from t join e on e.p = t.person)
    select person person_id, parent parent_person_id, depth from t"""
case("O6_subtree", "person_id:s parent_person_id:s depth:i", _SUB)(lambda g: tree.subtree(People(g).chart, "0", "t1", "hr", at=g.as_of))
case("O6_subtree_attributes", "person_id:s depth:i email:s display_name:s status:s",
     f"select person_id, depth, c_name email, null display_name, o_orderstatus status from ({_SUB}) join customer on c_custkey = person_id left join (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) o_orderstatus from orders group by 1) on o_custkey = person_id where depth <= 3")(
    lambda g: tree.with_attributes(
        tree.subtree(People(g).chart, "0", "t1", "hr", 3, g.as_of),
        g.customer.selectExpr("cast(c_custkey as string) as person_id", "'email' as value_type", "c_name as value_id", "cast(null as string) as value_full_text", "timestamp'2000-01-01 00:00:00' as created_at").unionByName(
            g.orders.selectExpr("cast(o_custkey as string) as person_id", "'status' as value_type", "cast(null as string) as value_id", "o_orderstatus as value_full_text", "o_orderdate as created_at")), g.as_of))

_VISIBLE = f"""with recursive e as ({_EDGES}), grants as (select c_custkey viewer, c_custkey person from customer union select o_custkey, o_orderkey from orders join customer on c_custkey = o_orderkey where o_orderstatus <> 'F'
      union select 5, c_custkey from customer where exists (select 1 from customer where c_custkey = 5)),
    v as (select viewer, person from grants union select v.viewer, e.c from v join e on e.p = v.person)"""
case("O7_visible_set", "viewer_person_id:s person_id:s", f"{_VISIBLE} select viewer viewer_person_id, person person_id from v")(lambda g: People(g).visible)
case("O7_forest", "viewer_person_id:s person_id:s parent_person_id:s depth:i",
     f"""{_VISIBLE}, roots as (select distinct viewer, c from v join e on e.c = v.person where (e.p is null or not exists (select 1 from v w join e e2 on e2.c = w.person where w.viewer = v.viewer and w.person = e.p))
           and e.c in (select p from e)),
         f as (select viewer, c person, null::bigint parent, 0 depth from roots union all select f.viewer, e.c, e.p, depth + 1 from f join e on e.p = f.person)
         select viewer viewer_person_id, person person_id, parent parent_person_id, depth from f qualify row_number() over (partition by viewer, person order by depth) = 1""")(
    lambda g: tree.forest(People(g).visible, People(g).chart, "t1", "hr", at=g.as_of))
case("O8_is_visible", "viewer_person_id:s viewed_person_id:s is_visible:b",
     f"{_VISIBLE} select t.viewer viewer_person_id, t.viewed viewed_person_id, v.person is not null is_visible from (select distinct o_custkey viewer, o_orderkey // 10 viewed from orders) t left join v on v.viewer = t.viewer and v.person = t.viewed")(
    lambda g: tree.is_visible(g.orders.selectExpr("cast(o_custkey as string) as viewer_person_id", "cast(o_orderkey div 10 as string) as viewed_person_id").distinct(), People(g).visible))

case("O9_by_email", "email:s person_id:s", "select upper(c_name) email, 'P' || c_custkey person_id from customer where c_nationkey between 5 and 9")(
    lambda g: identity.persons_by_email(People(g).known, g.customer.selectExpr("'t1' as tenant_id", "upper(c_name) as email")))
case("O9_by_source_id", "value_id:s person_id:s", "select c_custkey value_id, 'P' || c_custkey person_id from customer where c_nationkey < 5")(
    lambda g: identity.persons_by_source_id(People(g).known, g.customer.selectExpr("'t1' as tenant_id", "'hr' as source_type", "'s1' as source_id", "cast(c_custkey as string) as value_id")))
case("O9_source_ids", "person_id:s source_type:s value_id:s",
     "select person_id, 'hr' source_type, value_id from (select 'P' || (o_orderkey % 7) person_id, o_custkey value_id, o_orderdate at_, o_orderkey id from orders) qualify row_number() over (partition by person_id order by at_ desc, id desc) = 1")(
    lambda g: identity.source_ids(People(g).bindings))
case("O10_assemble_persons", "person_id:s email:s first_name:s last_name:s display_name:s status:s",
     f"""select {_P('c_custkey')} person_id, c_name email, 'First' first_name, 'Last' || c_custkey last_name, 'Last' || c_custkey || ', First' display_name,
         coalesce(s, '') status from customer left join (select o_custkey, arg_max(case when o_orderstatus = 'O' then 'Inactive' else 'Active' end, (o_orderdate, o_orderkey)) s from orders group by 1) on o_custkey = c_custkey""")(
    lambda g: identity.assemble_persons(People(g).observed))
case("O11_parents_and_children", "kind:s child_person_id:s parent_person_id:s",
     """select 'parent' kind, c_custkey child_person_id, case when c_custkey > 0 then (c_custkey - 1) // 4 end parent_person_id from customer where c_acctbal >= 0
        union all select 'child', c_custkey, (c_custkey - 1) // 4 from customer where c_acctbal >= 0 and c_custkey > 0""")(
    lambda g: tree.current_parents(People(g).chart).withColumn("kind", F.lit("parent")).unionByName(
        tree.current_children(People(g).chart).withColumn("kind", F.lit("child"))))

_MATCH_INPUTS = """
sides as (select 'a' side, 't1' tenant_id, case s_suppkey % 3 when 0 then 'hr' when 1 then 'git' else 'chat' end source_type, 'A' || s_suppkey who,
           case s_suppkey % 10 when 0 then 'user' || s_suppkey || '@acme.com' when 1 then 'User' || s_suppkey || '@ACME.com' when 2 then ' user' || s_suppkey || '+x@acme.com '
                when 3 then 'user' || s_suppkey || '@acme.io' when 4 then 'u' || s_suppkey || '@other.org' end email,
           case s_suppkey % 10 when 5 then 'u' || s_suppkey when 6 then 'U' || s_suppkey end username, case s_suppkey % 10 when 7 then 'E' || s_suppkey end employee_id,
           case s_suppkey % 10 when 8 then 'Costumer ' || lpad(s_suppkey::varchar, 9, '0') when 9 then 'Customer ' || lpad((s_suppkey // 10 * 10 + (s_suppkey + 3) % 10)::varchar, 9, '0')
                when 0 then 'Customer ' || lpad(s_suppkey::varchar, 9, '0') end display_name from supplier
         union all select 'k', 't1', 'hr', 'P' || c_custkey, 'user' || c_custkey || '@acme.com', 'u' || c_custkey, 'E' || c_custkey, 'Customer ' || lpad(c_custkey::varchar, 9, '0') from customer)"""
_MATCH = f"""with {_MATCH_INPUTS},
f as (select *, nullif(trim(email), '') _email, lower(nullif(trim(email), '')) _mail, nullif(trim(username), '') _user, lower(nullif(trim(username), '')) _user_lower,
        nullif(trim(employee_id), '') _employee, nullif(trim(regexp_replace(regexp_replace(lower(coalesce(display_name, '')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '') _name from sides),
g as (select *, regexp_replace(nullif(regexp_extract(_mail, '^([^@]*)@', 1), ''), '\\+.*$', '') _local, nullif(regexp_extract(_mail, '@([^@]*)$', 1), '') _domain from f),
h as (select *, _local || '@' || _domain _untagged, _local || '@' || case when _domain = 'acme.io' then 'acme.com' else _domain end _canonical,
        substr(_name, 1, 1) || translate(substr(_name, 2), 'bfpvcgjkqsxzdtlmnraeiouyhw', '111122222222334556') _phon from g),
a as (select * from h where side = 'a'), k as (select * from h where side = 'k'),
pairs as (
  select a.tenant_id, a.who account, a.source_type, k.who person, 'email_exact' r from a join k on a.tenant_id = k.tenant_id and a._email = k._email
  union all select a.tenant_id, a.who, a.source_type, k.who, 'hr_id_match' from a join k on a.tenant_id = k.tenant_id and a._employee = k._employee and a.source_type is not distinct from k.source_type
  union all select a.tenant_id, a.who, a.source_type, k.who, 'username_same_sys' from a join k on a.tenant_id = k.tenant_id and a._user = k._user and a.source_type is not distinct from k.source_type
  union all select a.tenant_id, a.who, a.source_type, k.who, 'email_case_norm' from a join k on a.tenant_id = k.tenant_id and a._mail = k._mail
  union all select a.tenant_id, a.who, a.source_type, k.who, 'email_plus_tag' from a join k on a.tenant_id = k.tenant_id and a._untagged = k._untagged
  union all select a.tenant_id, a.who, a.source_type, k.who, 'email_domain_alias' from a join k on a.tenant_id = k.tenant_id and a._canonical = k._canonical
  union all select a.tenant_id, a.who, a.source_type, k.who, 'username_cross_sys' from a join k on a.tenant_id = k.tenant_id and a._user_lower = k._user_lower and a.source_type is distinct from k.source_type
  union all select a.tenant_id, a.who, a.source_type, k.who, 'email_to_username' from a join k on a.tenant_id = k.tenant_id and (a._local = k._user_lower or a._user_lower = k._local) and a.source_type is distinct from k.source_type
  union all select a.tenant_id, a.who, a.source_type, k.who, 'name_edit' from a join k on a.tenant_id = k.tenant_id and levenshtein(a._name, k._name) <= 1
  union all select a.tenant_id, a.who, a.source_type, k.who, 'name_phonetic' from a join k on a.tenant_id = k.tenant_id and a._phon = k._phon),
rules(r, c, o, fuzzy) as (values ('email_exact', 1.0, 0, false), ('hr_id_match', 1.0, 1, false), ('username_same_sys', 0.95, 2, false), ('email_case_norm', 0.95, 3, false),
  ('email_plus_tag', 0.93, 4, false), ('email_domain_alias', 0.92, 5, false), ('username_cross_sys', 0.85, 6, false), ('name_edit', 0.75, 7, true),
  ('email_to_username', 0.72, 8, false), ('name_phonetic', 0.60, 9, true)),
best as (select tenant_id, account, source_type, person, arg_max(r, c * 1000 - o) rule, max(c) conf from pairs join rules using (r) group by all),
told as (select best.*, rules.fuzzy, count(*) filter (where conf >= 1.0) over (partition by tenant_id, account, source_type) sure from best join rules on rules.r = best.rule)
select tenant_id, source_type, account account_id, person person_id, rule condition_type, conf confidence,
       case when conf >= 1.0 and not fuzzy and sure = 1 then 'auto_link' when conf >= 0.5 then 'suggest' else 'pending' end action from told
union all select tenant_id, source_type, who, null, null, 0.0, 'pending' from a where not exists (select 1 from best where best.account = a.who and best.source_type = a.source_type)"""


def _match_sides(g: Given) -> tuple[DataFrame, DataFrame]:
    s, k = "s_suppkey", "s_suppkey % 10"
    accounts = g.table("supplier").selectExpr(
        "'t1' as tenant_id", f"case {s} % 3 when 0 then 'hr' when 1 then 'git' else 'chat' end as source_type", f"concat('A', {s}) as account_id",
        f"case {k} when 0 then concat('user', {s}, '@acme.com') when 1 then concat('User', {s}, '@ACME.com') when 2 then concat(' user', {s}, '+x@acme.com ') "
        f"when 3 then concat('user', {s}, '@acme.io') when 4 then concat('u', {s}, '@other.org') end as email",
        f"case {k} when 5 then concat('u', {s}) when 6 then concat('U', {s}) end as username", f"case {k} when 7 then concat('E', {s}) end as employee_id",
        f"case {k} when 8 then concat('Costumer ', lpad(cast({s} as string), 9, '0')) when 9 then concat('Customer ', lpad(cast({s} div 10 * 10 + ({s} + 3) % 10 as string), 9, '0')) "
        f"when 0 then concat('Customer ', lpad(cast({s} as string), 9, '0')) end as display_name")
    known = g.customer.selectExpr("'t1' as tenant_id", "concat('P', c_custkey) as person_id", "'hr' as source_type", "concat('user', c_custkey, '@acme.com') as email",
                                  "concat('u', c_custkey) as username", "concat('E', c_custkey) as employee_id", "concat('Customer ', lpad(cast(c_custkey as string), 9, '0')) as display_name")
    return accounts, known


case("O12_match_candidates", "tenant_id:s source_type:s account_id:s person_id:s condition_type:s confidence:f action:s", _MATCH)(
    lambda g: matching.match_candidates(*_match_sides(g), domain_aliases={"acme.io": "acme.com"}))
