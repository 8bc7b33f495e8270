"""UPS1-UPS6: batch upserts as closed forms.

Parquet has no in-place update, so each operator returns the new full
state (with an ``action`` column) and, where the reference answers per
request, one outcome row per request.  The reference applies requests one
by one; here the effect of a whole batch is derived per key from a few
partial aggregates (first arrival, first arrival with a company, ...),
which is exactly what the sequential loop converges to, and is joined back
once.  No driver loop, no per-key sort of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions.strings import norm_key
from haulframe.operators.joins import expand_grants, resolve_client
from haulframe.operators.nullsafe import join_on
from haulframe.operators.positions import global_row_number
from haulframe.session import ensure_checkpoint_dir, materialize

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: subscription answers.
MSG_REGISTERED = "Thank you for your request. You have been registered Successfully"
MSG_ALREADY = "Thank you for your request. This email is already registered with us"
MSG_OTHER_COMPANY = "Thank you for your request. This email is already registered under different company name"
# Area codes of the newsletter form: 1 -> 'lo', 2 -> 'ki', anything else -> ''.
AREA_CODES = {1: "lo", 2: "ki"}
# ---------------------------------------------------------------------------


def area_of(code: Column) -> Column:
    out = F.lit("")
    for k, v in AREA_CODES.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def _subscription_batch(state: DataFrame, requests: DataFrame):
    """Normalised requests joined to their stored row and per-email batch facts."""
    r = requests.select(
        "arrival", F.lower("em_nl").alias("email"), norm_key(F.col("cp_name")).alias("company"),
        area_of(F.col("tp_area")).alias("area"))
    real = F.col("company") != "none"
    facts = r.groupBy("email").agg(
        F.min("arrival").alias("first_arrival"),
        F.min_by("area", "arrival").alias("first_area"),
        F.min(F.when(real, F.col("arrival"))).alias("f_arrival"),
        F.min_by(F.when(real, F.struct("company", "area")), F.when(real, F.col("arrival"))).alias("_f"),
    ).select("email", "first_arrival", "first_area", "f_arrival",
             F.col("_f.company").alias("f_company"), F.col("_f.area").alias("f_area"))
    s = state.select(F.col("email").alias("email"), F.lower(F.coalesce("company", F.lit("none"))).alias("c0"),
                     F.col("area").alias("area0"), F.lit(True).alias("_stored"))
    return r, facts, s


def upsert_subscriptions(state: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UPS1: newsletter sign-ups.  Returns (outcomes per request, new state).

    state: email, company, area, removed; requests: arrival, em_nl, cp_name, tp_area.
    """
    r, facts, s = _subscription_batch(state, requests)
    # a request without an e-mail is answered too: null is a key of its own
    j = join_on(join_on(r, facts, ["email"]), s, ["email"], "left")
    stored = F.coalesce(F.col("_stored"), F.lit(False))
    real0 = stored & (F.col("c0") != "none")
    # stored company seen by this request
    before = (F.when(real0, F.col("c0"))
              .when(F.col("f_arrival").isNotNull() & (F.col("f_arrival") < F.col("arrival")), F.col("f_company"))
              .otherwise(F.lit("none")))
    no_row = ~stored & (F.col("arrival") == F.col("first_arrival"))
    outcome = (F.when(no_row, "registered")
               .when(before == "none", F.when(F.col("company") == "none", "already_registered").otherwise("registered"))
               .when(F.col("company") == before, "already_registered")
               .otherwise("different_company"))
    message = (F.when(outcome == "registered", MSG_REGISTERED).when(outcome == "already_registered", MSG_ALREADY)
               .otherwise(MSG_OTHER_COMPANY))
    outcomes = j.select("arrival", "email", "company", outcome.alias("outcome"), message.alias("message"))

    st = state.withColumn("_email", F.col("email")).withColumn("_is_stored", F.lit(True))
    facts = facts.withColumn("_is_requested", F.lit(True))
    n = st.join(facts, st["_email"].eqNullSafe(facts["email"]), "full_outer").select(
        F.coalesce(st["email"], facts["email"]).alias("email"), st["company"].alias("company0"),
        st["area"].alias("area0"), st["removed"].alias("removed0"), "first_area", "f_company", "f_area",
        st["_is_stored"].isNotNull().alias("_stored"), facts["_is_requested"].isNotNull().alias("_touched"))
    c0 = F.lower(F.coalesce("company0", F.lit("none")))
    keep = F.col("_stored") & (c0 != "none")
    company = F.when(keep, F.col("company0")).when(F.col("f_company").isNotNull(), F.col("f_company")).otherwise(
        F.when(F.col("_stored"), F.col("company0")).otherwise(F.lit("none")))
    area = F.when(keep, F.col("area0")).when(F.col("f_company").isNotNull(), F.col("f_area")).otherwise(
        F.when(F.col("_stored"), F.col("area0")).otherwise(F.col("first_area")))
    action = (F.when(~F.col("_stored"), "inserted")
              .when(F.col("_touched") & ~keep & F.col("f_company").isNotNull(), "updated").otherwise("unchanged"))
    new_state = n.select("email", company.alias("company"), area.alias("area"),
                         F.coalesce("removed0", F.lit(False)).alias("removed"), action.alias("action"))
    return outcomes, new_state


def upsert_clients(state: DataFrame, submissions: DataFrame, users: DataFrame) -> DataFrame:
    """UPS2: client intake after report submissions.

    state: client_id, user_id, company, email, contact_name;
    submissions: arrival, email_nm, cp_nm, client_nm; users: user_id, email.
    Only the first submission of an e-mail can change the state (every later
    one finds the client the first created or linked).  A user without a
    client updates the client with that e-mail (company, contact, user) or
    creates it; with neither user nor client a client is created.
    """
    res = resolve_client(submissions.select("arrival", "email_nm"), users,
                         state.select("client_id", "user_id", "email"))
    sub = submissions.select("arrival", "cp_nm", "client_nm")
    res = res.join(sub, "arrival")
    first = res.groupBy("email").agg(F.min_by(F.struct("arrival", "branch", "user_id", "client_id", "cp_nm",
                                                      "client_nm"), F.col("arrival")).alias("_f")).select(
        "email", "_f.*")
    # one row per e-mail, read by the update and the insert branches: computed once
    ensure_checkpoint_dir(state.sparkSession)
    first = first.transform(lambda d: materialize(d, "first-submissions"))
    acting = first.where(F.col("branch").isin("update_or_create", "create"))
    upd = acting.where(F.col("client_id").isNotNull()).select(
        F.col("client_id").alias("_cid"), F.col("user_id").alias("_uid"), F.col("cp_nm").alias("_company"),
        F.col("client_nm").alias("_contact"), F.col("branch").alias("_branch"))
    cur = state.join(upd, state["client_id"] == upd["_cid"], "left")
    changed = F.col("_cid").isNotNull()
    updated = cur.select(
        "client_id",
        F.when(changed & (F.col("_branch") == "update_or_create"), F.col("_uid")).otherwise(F.col("user_id"))
        .alias("user_id"),
        F.when(changed, F.col("_company")).otherwise(F.col("company")).alias("company"),
        "email",
        F.when(changed, F.col("_contact")).otherwise(F.col("contact_name")).alias("contact_name"),
        F.when(changed, F.lit("updated")).otherwise(F.lit("unchanged")).alias("action"))
    ins = acting.where(F.col("client_id").isNull())
    base = state.select(F.max("client_id")).scalar()
    ins = global_row_number(ins, [F.col("arrival").asc()], "_n").select(
        (F.coalesce(base, F.lit(0)) + F.col("_n")).cast("bigint").alias("client_id"),
        F.when(F.col("branch") == "update_or_create", F.col("user_id")).cast("bigint").alias("user_id"),
        F.col("cp_nm").alias("company"), "email", F.col("client_nm").alias("contact_name"),
        F.lit("inserted").alias("action"))
    return updated.unionByName(ins)


def book_calls(clients: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UPS3: call requests of known clients.  Returns (new client state, call rows).

    clients: client_id, email, company, contact_name, phone;
    requests: arrival, em_nm, cp_nm, client_nm, phone_nb.
    Missing contact / company are filled from the first request that has
    one; the phone becomes the last one given; one call row per request;
    requests with an unknown e-mail are dropped.
    """
    first_client = clients.groupBy("email").agg(F.min("client_id").alias("client_id"))
    r = requests.withColumn("email", F.lower("em_nm")).join(first_client, "email")
    calls = r.select("arrival", "client_id", F.lit(False).alias("called"))

    def nonempty(c):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))

    facts = r.groupBy("client_id").agg(
        F.min_by(nonempty("client_nm"), F.when(nonempty("client_nm").isNotNull(), F.col("arrival"))).alias("_contact"),
        F.min_by(nonempty("cp_nm"), F.when(nonempty("cp_nm").isNotNull(), F.col("arrival"))).alias("_company"),
        F.max_by("phone_nb", "arrival").alias("_phone"))
    facts = facts.withColumn("_req", F.lit(True))
    j = clients.join(facts, "client_id", "left")
    req = F.col("_req").isNotNull()
    company = F.when(req & (F.coalesce(F.col("company"), F.lit("")) == ""), F.col("_company")).otherwise(F.col("company"))
    contact = F.when(req & (F.coalesce(F.col("contact_name"), F.lit("")) == ""), F.col("_contact")).otherwise(
        F.col("contact_name"))
    state = j.select("client_id", "email", company.alias("company"), contact.alias("contact_name"),
                     F.when(req, F.col("_phone")).otherwise(F.col("phone")).alias("phone"),
                     F.when(req, F.lit("updated")).otherwise(F.lit("unchanged")).alias("action"))
    return state, calls


def update_by_id(df: DataFrame, updates: DataFrame, id_col: str, arrival: str, replace: bool = False) -> DataFrame:
    """UPS4: merge updates into rows, or replace rows, by id; unknown ids are ignored.

    Merging applies all updates of an id in order of arrival, so each
    column ends with its last non-null new value; replacing takes the last
    update as the whole row.  One aggregate either way.
    """
    cols = [c for c in df.columns if c in updates.columns and c not in (id_col, arrival)]
    if replace:
        new = updates.groupBy(id_col).agg(F.max_by(F.struct(*cols), F.col(arrival)).alias("_u")).select(
            id_col, *[F.col(f"_u.{c}").alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    else:
        new = updates.groupBy(id_col).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(f"_new_{c}")
                                            for c in cols], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    kinds = dict(df.dtypes)

    def after(c: str) -> Column:
        if c == id_col or (c not in cols and not replace):
            return F.col(c)
        value = F.col(f"_new_{c}") if c in cols else F.lit(None).cast(kinds[c])
        return F.when(hit, value if replace else F.coalesce(value, F.col(c))).otherwise(F.col(c)).alias(c)

    return df.join(new, id_col, "left").select(
        *[after(c) for c in df.columns], F.when(hit, "updated").otherwise("unchanged").alias("action"))


def remove_rows(df: DataFrame, field: str, values: list) -> DataFrame:
    """UPS5: delete rows whose field is in the list; rows without a value are kept."""
    return df.where(F.col(field).isNull() | ~F.col(field).isin(values))


def signup(users: DataFrame, perms: DataFrame, batch_id: str) -> DataFrame:
    """UPS6: sign-up fan-out in one batch: user, profile, permissions and group rows.

    users: user_id, username, email, user_type.  Returns one long table
    (table_name, user_id, detail, batch_id) so the batch is written as a
    single unit; split it by ``table_name`` when storing.
    """
    own = F.array(
        F.struct(F.lit("user").alias("kind"), F.concat_ws("|", "username", "email", F.lit("staff=false")).alias("grant")),
        F.struct(F.lit("profile").alias("kind"), F.col("user_type").alias("grant")))
    table = F.when(F.col("kind") == "group", "group_member").when(F.col("kind") == "permission", "user_permission").otherwise(
        F.col("kind"))
    rows = users.select("user_id", F.explode(own).alias("_g")).select("user_id", "_g.kind", "_g.grant")
    rows = rows.unionByName(expand_grants(users.select("user_id", "user_type"), perms))
    return rows.select(table.alias("table_name"), "user_id", F.col("grant").alias("detail"),
                       F.lit(batch_id).alias("batch_id"))
