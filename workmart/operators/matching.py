"""Match candidates: persons that an unbound account may belong to, each by a rule with a confidence.

Every rule is an equality of normal forms, so every rule is one equi-join of the accounts with the known identities on
(tenant, key): exact and normalised e-mails, e-mail without its +tag, e-mail under its canonical domain, ids and user
names within and across systems, the e-mail's local part against a user name, and names. A key shared by a third of
all rows is one join key that the adaptive skew join splits; its pairs are real candidates of the rule.

Names are compared by two fuzzy rules that never link by themselves:

* `name_edit`: normal names at most one edit apart (Levenshtein). Blocks are deletion keys: a name and each of its
  one-code-point deletions. Two names within one edit share a key (equal names their own, a replacement the deletion
  at its place, an insertion the shorter name and a deletion of the longer), so only pairs that may be near meet
  (besides a few, such as swapped neighbours), and Levenshtein (built in) confirms them.
* `name_phonetic`: the same phonetic code of the normal name (first letter, then consonant classes of the soundex
  table, vowels and h, w, y left out, digits and spaces kept).

A pair of account and person keeps its best rule (highest confidence, then the rule listed first). Its action is
`auto_link` if the confidence is 1.0, the rule is not fuzzy and no other person reaches 1.0 for that account;
`suggest` from 0.5; `pending` below. Accounts without any candidate get one row with no person and `pending`.

Odd inputs: null, empty or blank values match nothing (they are null after trimming); repeated identities of one person
count once; an empty side gives accounts that are all pending (or no rows). Extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values from the matching design: rule, confidence, whether it is fuzzy.
RULES = (
    ("email_exact", 1.0, False),
    ("hr_id_match", 1.0, False),
    ("username_same_sys", 0.95, False),
    ("email_case_norm", 0.95, False),
    ("email_plus_tag", 0.93, False),
    ("email_domain_alias", 0.92, False),
    ("username_cross_sys", 0.85, False),
    ("name_edit", 0.75, True),
    ("email_to_username", 0.72, False),
    ("name_phonetic", 0.60, True),
)
AUTO_LINK, SUGGEST = 1.0, 0.5
# The soundex classes of consonants; other letters are left out of a phonetic code.
PHONETIC_FROM, PHONETIC_TO = "bfpvcgjkqsxzdtlmnraeiouyhw", "111122222222334556"
COLUMNS = ("tenant_id", "source_type", "email", "username", "employee_id", "display_name")


def _clean(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def normal_name(c: str) -> Column:
    """Lower case, letters, digits and single spaces only; null if nothing is left."""
    kept = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9 ]", "")
    return F.nullif(F.trim(F.regexp_replace(kept, " +", " ")), F.lit(""))


def phonetic(name: Column) -> Column:
    return F.concat(F.substring(name, 1, 1), F.translate(F.substring(name, 2, 1 << 30), PHONETIC_FROM, PHONETIC_TO))


def _forms(df: DataFrame, domain_aliases: dict[str, str]) -> DataFrame:
    """Normal forms of a side: trimmed values, lower-cased e-mail parts, canonical domain, normal name."""
    mail = F.lower(_clean("email"))
    local, domain = F.nullif(F.regexp_extract(mail, "^([^@]*)@", 1), F.lit("")), F.nullif(F.regexp_extract(mail, "@([^@]*)$", 1), F.lit(""))
    base = F.regexp_replace(local, "\\+.*$", "")
    canon = F.coalesce(F.create_map(*[F.lit(x) for kv in domain_aliases.items() for x in kv])[domain], domain) if domain_aliases else domain
    return df.select(
        "_who", "tenant_id", "source_type", _clean("email").alias("_email"), mail.alias("_mail"), F.concat(base, F.lit("@"), domain).alias("_untagged"),
        F.concat(base, F.lit("@"), canon).alias("_canonical"), base.alias("_local"), _clean("username").alias("_user"), F.lower(_clean("username")).alias("_user_lower"),
        _clean("employee_id").alias("_employee"), normal_name("display_name").alias("_name"))


def _keys(side: DataFrame) -> DataFrame:
    """One row for each rule key of each identity: _who, tenant_id, source_type, _rule, _key."""
    plain = [("email_exact", "_email"), ("hr_id_match", "_employee"), ("username_same_sys", "_user"), ("email_case_norm", "_mail"), ("email_plus_tag", "_untagged"),
             ("email_domain_alias", "_canonical"), ("username_cross_sys", "_user_lower")]
    rows = [side.select("_who", "tenant_id", "source_type", F.lit(rule).alias("_rule"), F.col(c).alias("_key")) for rule, c in plain]
    rows.append(side.select("_who", "tenant_id", "source_type", F.lit("name_phonetic").alias("_rule"), phonetic(F.col("_name")).alias("_key")))
    return reduce(DataFrame.unionByName, rows).filter(F.col("_key").isNotNull())


def _deletions(side: DataFrame) -> DataFrame:
    """Deletion keys of normal names: the name (place -1) and each one-code-point deletion with its place."""
    named = side.filter(F.col("_name").isNotNull()).select("_who", "tenant_id", "source_type", "_name")
    at = named.select("*", F.explode(F.sequence(F.lit(-1), F.length("_name") - 1)).alias("_at"))
    key = F.when(F.col("_at") < 0, F.col("_name")).otherwise(F.expr("concat(substring(_name, 1, _at), substring(_name, _at + 2))"))
    return at.select("_who", "tenant_id", "source_type", "_name", key.alias("_key"))


def match_candidates(accounts: DataFrame, known: DataFrame, domain_aliases: dict[str, str] | None = None) -> DataFrame:
    """accounts (tenant_id, source_type, account_id, email, username, employee_id, display_name) and known identities
    (tenant_id, person_id, source_type, email, username, employee_id, display_name): tenant_id, source_type,
    account_id, person_id, condition_type, confidence, action, as the module says."""
    aliases = domain_aliases or {}
    a = _forms(accounts.select(F.struct(F.col("account_id").cast("string").alias("account_id"), F.col("source_type").alias("account_source")).alias("_who"), *COLUMNS), aliases)
    k = _forms(known.select(F.col("person_id").cast("string").alias("_who"), *COLUMNS), aliases).dropDuplicates()
    ak, kk = _keys(a), _keys(k).dropDuplicates(["_who", "tenant_id", "source_type", "_rule", "_key"])
    on = (F.col("a.tenant_id") == F.col("k.tenant_id")) & (F.col("a._rule") == F.col("k._rule")) & (F.col("a._key") == F.col("k._key"))
    same, rule = F.col("a.source_type").eqNullSafe(F.col("k.source_type")), F.col("a._rule")
    needs = (F.when(rule.isin("hr_id_match", "username_same_sys"), same).when(rule == "username_cross_sys", ~same).otherwise(F.lit(True)))
    exact = ak.alias("a").join(kk.alias("k"), on).filter(needs).select(F.col("a._who").alias("_account"), F.col("a.tenant_id").alias("tenant_id"), F.col("k._who").alias("person_id"), rule.alias("_rule"))
    # the e-mail's local part against a user name of another system, both ways
    to_user = [x.alias("a").join(y.alias("k"), (F.col("a.tenant_id") == F.col("k.tenant_id")) & (F.col(f"a.{p}") == F.col(f"k.{q}")) & ~F.col("a.source_type").eqNullSafe(F.col("k.source_type")))
               .select(F.col("a._who").alias("_account"), F.col("a.tenant_id").alias("tenant_id"), F.col("k._who").alias("person_id"), F.lit("email_to_username").alias("_rule"))
               for x, y, p, q in ((a.filter(F.col("_local").isNotNull()), k.filter(F.col("_user_lower").isNotNull()), "_local", "_user_lower"),
                                  (a.filter(F.col("_user_lower").isNotNull()), k.filter(F.col("_local").isNotNull()), "_user_lower", "_local"))]
    da, dk = _deletions(a), _deletions(k).dropDuplicates(["_who", "tenant_id", "_key"])
    near = (da.alias("a").join(dk.alias("k"), (F.col("a.tenant_id") == F.col("k.tenant_id")) & (F.col("a._key") == F.col("k._key")))
            .filter(F.levenshtein(F.col("a._name"), F.col("k._name")) <= 1)
            .select(F.col("a._who").alias("_account"), F.col("a.tenant_id").alias("tenant_id"), F.col("k._who").alias("person_id"), F.lit("name_edit").alias("_rule")))
    found = reduce(DataFrame.unionByName, [exact, *to_user, near])
    table = F.create_map(*[x for i, (r, c, fz) in enumerate(RULES) for x in (F.lit(r), F.struct(F.lit(c).alias("c"), F.lit(-i).alias("o"), F.lit(fz).alias("fuzzy")))])
    best = found.select("_account", "tenant_id", "person_id", table[F.col("_rule")].alias("_s"), "_rule").groupBy("_account", "tenant_id", "person_id").agg(
        F.max(F.struct(F.col("_s.c").alias("c"), F.col("_s.o").alias("o"), F.col("_s.fuzzy").alias("fuzzy"), F.col("_rule").alias("rule"))).alias("_b"))
    sure = F.col("_b.c") >= AUTO_LINK
    linked = best.groupBy("_account", "tenant_id").agg(F.count(F.when(sure, 1)).alias("_sure"))
    action = F.when(sure & ~F.col("_b.fuzzy") & (F.col("_sure") == 1), "auto_link").when(F.col("_b.c") >= SUGGEST, "suggest").otherwise("pending")
    rows = best.join(linked, ["_account", "tenant_id"]).select(
        "tenant_id", F.col("_account.account_source").alias("source_type"), F.col("_account.account_id").alias("account_id"), "person_id",
        F.col("_b.rule").alias("condition_type"), F.col("_b.c").alias("confidence"), action.alias("action"))
    alone = a.select("_who", "tenant_id").dropDuplicates().join(best.select(F.col("_account").alias("_who"), "tenant_id").dropDuplicates(), ["_who", "tenant_id"], "left_anti").select(
        "tenant_id", F.col("_who.account_source").alias("source_type"), F.col("_who.account_id").alias("account_id"), F.lit(None).cast("string").alias("person_id"),
        F.lit(None).cast("string").alias("condition_type"), F.lit(0.0).alias("confidence"), F.lit("pending").alias("action"))
    return rows.unionByName(alone)
