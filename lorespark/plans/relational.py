"""Queries over lists, access, lifecycle and audit, each with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import text as T
from lorespark.operators import access, lifecycle, lists
from lorespark.sources import keyed, tables

from . import standins as S

QUERIES, ORACLES = {}, {}
ADMIN_USER = 7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def own_members(spark, sf_dir, user=ADMIN_USER):
    return S.members(spark, sf_dir).where(F.col("user_id") == user)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' AND o_totalprice < 100000 AND o_custkey IS NOT NULL GROUP BY ALL")
def scan_filters(spark, sf_dir):
    rows = tables.matching(tables.load(spark, sf_dir, "orders"), o_orderpriority=["1-URGENT", "2-HIGH"], o_clerk=None)
    rows = rows.where("o_orderstatus <> 'F' AND o_totalprice < 100000 AND o_custkey IS NOT NULL")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def multi_key_lookup(spark, sf_dir):
    ids = S.read(spark, sf_dir, "lineitem").where("l_quantity >= 50").select("l_orderkey")
    return tables.by_ids(S.read(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'")
def unique_lookup(spark, sf_dir):
    return tables.matching(S.read(spark, sf_dir, "customer"), c_name="Customer#000000042").select("c_custkey", "c_name")


_STATUS_SQL = "CASE status " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in tables.DOCUMENT_STATUS.items()) + " ELSE 'UNKNOWN' END"


@query(
    S.with_("documents_", "members_")
    + f"SELECT id, kb_id, file_name, {_STATUS_SQL} AS status_label FROM documents_ WHERE kb_id IN (SELECT 'src' || kb_id FROM members_ WHERE user_id = {ADMIN_USER}) AND file_name ILIKE '%E%' AND status = 3 ORDER BY create_time DESC, id LIMIT 100"
)
def list_documents_visible(spark, sf_dir):
    mine = own_members(spark, sf_dir).select(F.concat(F.lit("src"), F.col("kb_id").cast("string")).alias("kb_id"))
    found = lists.list_documents(S.documents(spark, sf_dir), mine, keyword="E", status=3)
    return found.select("id", "kb_id", "file_name", tables.label(F.col("status"), tables.DOCUMENT_STATUS).alias("status_label"))


@query(
    S.with_("tasks_", "task_documents_", "bases_", "members_")
    + f""", newest AS (SELECT * FROM tasks_ WHERE status = 0 AND (task_no ILIKE '%7%' OR document_id IN (SELECT id FROM task_documents_ WHERE file_name ILIKE '%7%')) ORDER BY create_time DESC, id LIMIT 100)
    SELECT n.id, task_no, document_id, file_name, d.kb_id, kb_name FROM newest n JOIN task_documents_ d ON d.id = n.document_id LEFT JOIN bases_ b ON b.kb_id = d.kb_id
    WHERE d.kb_id IN (SELECT kb_id FROM members_ WHERE user_id = {ADMIN_USER})"""
)
def list_tasks_topk_then_filter(spark, sf_dir):
    found = lists.list_tasks(
        S.tasks(spark, sf_dir), S.task_documents(spark, sf_dir), S.bases(spark, sf_dir), own_members(spark, sf_dir), keyword="7", status=0
    )
    return found.select("id", "task_no", "document_id", "file_name", "kb_id", "kb_name")


@query(
    S.with_("tasks_", "task_documents_", "bases_")
    + """, newest AS (SELECT * FROM tasks_ ORDER BY create_time DESC, id LIMIT 100)
    SELECT n.id, document_id, d.kb_id, kb_name FROM newest n JOIN task_documents_ d ON d.id = n.document_id LEFT JOIN bases_ b ON b.kb_id = d.kb_id WHERE d.kb_id IN (5)"""
)
def list_tasks_of_base(spark, sf_dir):
    """An administrator's list for one knowledge base, with a status that there isn't."""
    found = lists.list_tasks(S.tasks(spark, sf_dir), S.task_documents(spark, sf_dir), S.bases(spark, sf_dir), None, status=9, kb=5)
    return found.select("id", "document_id", "kb_id", "kb_name")


@query(
    S.with_("documents_")
    + f"""SELECT id, '{{"id":' || id || ',"fileName":"' || file_name || '","statusText":"' || {_STATUS_SQL} || '","version":' || version || CASE WHEN id % 2 = 0 THEN '' ELSE ',"expired":' || (status = 6) END || '}}' AS row FROM documents_"""
)
def document_rows_json(spark, sf_dir):
    """Documents as the service's rows; null fields are left out."""
    status = F.col("status")
    row = F.struct(
        "id", F.col("file_name").alias("fileName"), tables.label(status, tables.DOCUMENT_STATUS).alias("statusText"), "version", F.when(F.col("id") % 2 == 1, status == 6).alias("expired")
    )
    return S.documents(spark, sf_dir).select("id", F.to_json(row).alias("row"))


@query(S.with_("role_", "documents_") + "SELECT 'role' AS list, code AS name, sort AS v, row_number() OVER (ORDER BY sort, role_id) AS pos FROM role_ UNION ALL SELECT 'version', file_name, version, row_number() OVER (PARTITION BY file_name ORDER BY version DESC) FROM documents_")
def plain_orders(spark, sf_dir):
    """Roles by their sort, and the versions of each name from the newest down."""
    roles = S.role(spark, sf_dir)  # a handful
    by_sort = roles.select(F.lit("role").alias("list"), F.col("code").alias("name"), F.col("sort").cast("long").alias("v"), F.row_number().over(Window.orderBy("sort", "role_id")).cast("long").alias("pos"))
    newest = Window.partitionBy("file_name").orderBy(F.desc("version"))
    versions = S.documents(spark, sf_dir).select(F.lit("version").alias("list"), F.col("file_name").alias("name"), F.col("version").alias("v"), F.row_number().over(newest).cast("long").alias("pos"))
    return by_sort.union(versions)


@query(
    S.with_("bases_", "creators_")
    + "SELECT kb_id, kb_name, coalesce(nullif(trim(nickname), ''), username, create_user::VARCHAR) AS creator FROM bases_ LEFT JOIN creators_ ON user_id = create_user"
)
def bases_with_creators(spark, sf_dir):
    return lists.with_creators(S.bases(spark, sf_dir), S.creators(spark, sf_dir)).select("kb_id", "kb_name", "creator")


@query(S.with_("members_") + "SELECT kb_id, user_id, role, c_name AS username FROM members_ LEFT JOIN customer ON c_custkey = user_id")
def members_with_names(spark, sf_dir):
    users = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return lists.members_with_names(S.members(spark, sf_dir), users).select("kb_id", "user_id", "role", "username")


@query(
    S.with_("user_role_", "role_")
    + "SELECT c_custkey AS user_id, coalesce(string_agg(code, ',' ORDER BY code), '') AS roles FROM customer LEFT JOIN user_role_ u ON u.user_id = c_custkey LEFT JOIN role_ r ON r.role_id = u.role_id GROUP BY ALL"
)
def users_with_roles(spark, sf_dir):
    users = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return access.users_with_roles(users, S.user_role(spark, sf_dir), S.role(spark, sf_dir))


@query(
    S.with_("user_role_", "role_")
    + """SELECT c_custkey AS user_id, coalesce('[' || string_agg('{"role_id":' || r.role_id || ',"code":"' || code || '","sort":' || sort || '}', ',' ORDER BY r.role_id) || ']', '[]') AS roles
    FROM customer LEFT JOIN user_role_ u ON u.user_id = c_custkey LEFT JOIN role_ r ON r.role_id = u.role_id GROUP BY ALL"""
)
def users_with_role_structs(spark, sf_dir):
    users = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return access.roles_of(users, S.user_role(spark, sf_dir), S.role(spark, sf_dir)).select("user_id", F.to_json("roles").alias("roles"))


@query(
    S.with_("user_role_", "role_permission_", "permission_")
    + "SELECT DISTINCT user_id, code FROM user_role_ JOIN role_permission_ USING (role_id) JOIN permission_ USING (permission_id) WHERE status = 1"
)
def rbac_permissions(spark, sf_dir):
    return access.permissions(S.user_role(spark, sf_dir), S.role_permission(spark, sf_dir), S.permission(spark, sf_dir))


@query(S.with_("user_role_", "role_") + "SELECT DISTINCT user_id FROM user_role_ JOIN role_ USING (role_id) WHERE code = 'ADMIN'")
def is_admin(spark, sf_dir):
    return access.admins(S.user_role(spark, sf_dir), S.role(spark, sf_dir))


@query(S.with_("user_role_", "role_") + "SELECT role_id, code, count(user_id) AS n_users FROM role_ LEFT JOIN user_role_ USING (role_id) GROUP BY ALL")
def users_per_role(spark, sf_dir):
    return access.users_per_role(S.role(spark, sf_dir), S.user_role(spark, sf_dir)).select("role_id", "code", "n_users")


_LAST = "SELECT kb_id, any_value(user_id) AS user_id FROM members_ WHERE role = 'OWNER' GROUP BY kb_id HAVING count(*) = 1"


@query(S.with_("order_members_") + _LAST.replace("members_", "order_members_"))
def last_owner_kbs(spark, sf_dir):
    return access.last_owners(S.order_members(spark, sf_dir))


@query(
    S.with_("order_members_", "user_role_", "role_")
    + f""", gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ({_LAST.replace("members_", "order_members_")})) AND c_custkey NOT IN
        (SELECT min(user_id) FROM user_role_ JOIN role_ USING (role_id) WHERE code = 'ADMIN' HAVING count(DISTINCT user_id) = 1))
    SELECT 'user' AS side, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM gone) UNION ALL SELECT 'members', count(*) FROM order_members_ WHERE user_id NOT IN (FROM gone)
    UNION ALL SELECT 'user_role', count(*) FROM user_role_ WHERE user_id NOT IN (FROM gone)"""
)
def delete_users(spark, sf_dir):
    """All users are to go; those who may not stay with their memberships and roles."""
    users = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    left = access.delete_users(users, S.order_members(spark, sf_dir), S.user_role(spark, sf_dir), S.role(spark, sf_dir), users)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n") for s, t in zip(("user", "members", "user_role"), left)]
    return counts[0].union(counts[1]).union(counts[2])


@query(S.with_("members_") + "SELECT c_custkey AS user_id, c_name AS username FROM customer WHERE c_name ILIKE '%CUSTOMER#%9%' AND c_custkey NOT IN (SELECT user_id FROM members_) ORDER BY 1 LIMIT 20")
def search_non_members(spark, sf_dir):
    users = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username")).where(F.col("username").contains("9"))
    return lists.search_users(access.non_members(users, S.members(spark, sf_dir)), "customer#")


@query(
    S.with_("members_")
    + "SELECT kb_id, user_id, coalesce(g, role) AS role FROM members_ FULL JOIN (SELECT c_nationkey::BIGINT AS kb_id, c_custkey AS user_id, 'EDITOR' AS g FROM customer WHERE c_nationkey < 20) USING (kb_id, user_id)"
)
def grant_members(spark, sf_dir):
    new = S.read(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").cast("long").alias("kb_id"), F.col("c_custkey").alias("user_id"), F.lit("EDITOR").alias("role"))
    return access.grant(S.members(spark, sf_dir), new)


@query(S.with_("members_") + f"SELECT kb_id, user_id, role FROM members_ WHERE NOT (role = 'VIEWER' OR user_id % 3 = 0) OR (kb_id, user_id) IN (SELECT kb_id, user_id FROM ({_LAST}))")
def revoke_members(spark, sf_dir):
    members = S.members(spark, sf_dir)
    return access.revoke(members, members.where("role = 'VIEWER' OR user_id % 3 = 0"))


@query(S.with_("members_") + "SELECT user_id, count(*) FILTER (role IN ('EDITOR', 'OWNER')) AS n_editable FROM members_ GROUP BY ALL HAVING count(*) FILTER (role IN ('EDITOR', 'OWNER')) > 0")
def editable_kbs(spark, sf_dir):
    return access.with_role(S.members(spark, sf_dir), "EDITOR").groupBy("user_id").agg(F.count("*").alias("n_editable"))


@query(S.with_("user_role_") + "SELECT user_id, role_id FROM user_role_ WHERE role_id <> 5 UNION ALL SELECT user_id, 1 FROM user_role_ WHERE role_id = 5")
def overwrite_roles(spark, sf_dir):
    old = S.user_role(spark, sf_dir)
    return access.overwrite_relation(old, old.where("role_id = 5").select("user_id", F.lit(1).alias("role_id")), "user_id")


@query(S.with_("user_role_", "role_", "role_permission_") + "SELECT 'user' AS side, count(*) AS n FROM user_role_ WHERE role_id NOT IN (5, 6) UNION ALL SELECT 'role', count(*) FROM role_ WHERE role_id NOT IN (5, 6) UNION ALL SELECT 'permission', count(*) FROM role_permission_ WHERE role_id NOT IN (5, 6)")
def delete_roles(spark, sf_dir):
    gone = S.role(spark, sf_dir).where("role_id IN (0, 5, 6)").select("role_id")
    role, user, permission = access.delete_roles(S.role(spark, sf_dir), S.user_role(spark, sf_dir), S.role_permission(spark, sf_dir), gone)
    sides = [t.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n") for s, t in (("user", user), ("role", role), ("permission", permission))]
    return sides[0].union(sides[1]).union(sides[2])


@query(
    S.with_("members_", "user_role_", "role_")
    + f"""SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ({_LAST})) AND c_custkey NOT IN
    (SELECT min(user_id) FROM user_role_ JOIN role_ USING (role_id) WHERE code = 'ADMIN' HAVING count(DISTINCT user_id) = 1)"""
)
def deletable_users(spark, sf_dir):
    users = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return access.deletable_users(users, S.members(spark, sf_dir), S.user_role(spark, sf_dir), S.role(spark, sf_dir))


@query(S.with_("role_", "permission_", "role_permission_") + "SELECT role_id, permission_id FROM role_ CROSS JOIN permission_ WHERE role_.code = 'ADMIN' AND (role_id, permission_id) NOT IN (SELECT role_id, permission_id FROM role_permission_)")
def admin_permission_seed(spark, sf_dir):
    return access.seed_permissions(S.role(spark, sf_dir), S.permission(spark, sf_dir), S.role_permission(spark, sf_dir))


@query("SELECT event_type AS action, user_id % 20 AS kb_id, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
def audit_by_action(spark, sf_dir):
    return S.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action"), (F.col("user_id") % 20).alias("kb_id")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def audit_json_field(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return S.read(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id, left(props || repeat('x', 600), 500) AS detail FROM events UNION ALL SELECT event_id + 1000000, left('again ' || props, 500) FROM events WHERE event_type = 'error'")
def audit_append(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events")
    log = access.audit(rows.limit(0).select("event_id", F.col("props").alias("detail")), rows.select("event_id", F.concat("props", F.lit("x" * 600)).alias("detail")))
    return access.audit(log, rows.where("event_type = 'error'").select((F.col("event_id") + 1000000).alias("event_id"), F.concat(F.lit("again "), "props").alias("detail")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark, sf_dir):
    return lists.first_of(S.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_PARTS = "SELECT l_orderkey AS id, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS skipped, count(*) FILTER (l_linestatus = 'F') AS stored FROM lineitem GROUP BY ALL"


@query(
    S.with_("tasks_")
    + f""", p AS ({_PARTS}) SELECT id, total, stored * 100 // total AS percent, greatest(0, total - skipped - stored) AS failed,
    CASE WHEN status >= 2 THEN 100 ELSE least(100, round(stored * 100 / total)::BIGINT) END AS shown, status IN (0, 1) AS running FROM tasks_ JOIN p USING (id)"""
)
def task_progress(spark, sf_dir):
    lines = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("skipped"), F.count_if(F.col("l_linestatus") == "F").alias("stored")
    )
    shown = F.when(F.col("status") >= 2, 100).otherwise(F.least(F.lit(100), F.round(F.col("stored") * 100 / F.col("total")).cast("long")))
    return S.tasks(spark, sf_dir).join(lines, "id").select(
        "id", "total", lifecycle.progress(F.col("stored"), F.col("total")).alias("percent"),
        lifecycle.failed_chunks(F.col("total"), F.col("skipped"), F.col("stored")).cast("long").alias("failed"), shown.cast("long").alias("shown"), F.col("status").isin(0, 1).alias("running"),
    )


@query(S.with_("tasks_") + "SELECT document_id, bool_or(status IN (0, 1)) AS any_running, count(*) FILTER (status IN (0, 1)) AS n_running FROM tasks_ GROUP BY ALL")
def running_tasks(spark, sf_dir):
    running = F.col("status").isin(0, 1)
    return S.tasks(spark, sf_dir).groupBy("document_id").agg(F.bool_or(running).alias("any_running"), F.count_if(running).alias("n_running"))


@query(S.with_("tasks_") + "SELECT id, CASE WHEN status = 0 AND document_id % 5 = 0 THEN 1 ELSE status END AS status FROM tasks_")
def claim_tasks(spark, sf_dir):
    tasks = S.tasks(spark, sf_dir)
    return lifecycle.claim(tasks, tasks.where("document_id % 5 = 0").select("id"))[0].select("id", "status")


@query(S.with_("tasks_") + "SELECT id, CASE WHEN status IN (0, 1) THEN 0 ELSE status END AS status, CASE WHEN status IN (0, 1) THEN 1 ELSE 0 END AS retry_count FROM tasks_")
def reset_tasks(spark, sf_dir):
    return lifecycle.reset(S.tasks(spark, sf_dir).withColumn("retry_count", F.lit(0))).select("id", "status", "retry_count")


@query(S.with_("documents_") + "SELECT kb_id, file_name, max(version) + 1 AS next_version FROM documents_ GROUP BY ALL")
def next_version(spark, sf_dir):
    return lifecycle.next_versions(S.documents(spark, sf_dir))


@query(S.with_("documents_") + f"SELECT id, CASE WHEN status IN (3, 5) AND expire_time < TIMESTAMP '{S.NOW}' THEN 6 ELSE status END AS status FROM documents_")
def expire_overdue(spark, sf_dir):
    return lifecycle.expire_overdue(S.documents(spark, sf_dir), S.now()).select("id", "status")


_OLD = "status = 3 AND id % 2 = 0 AND (kb_id, file_name) IN (SELECT kb_id, file_name FROM documents_ WHERE status = 4) AND id NOT IN (SELECT id FROM documents_ WHERE status = 4)"


@query(
    S.with_("documents_")
    + f"""SELECT id, CASE WHEN {_OLD} THEN 5 ELSE status END AS status,
    strftime(CASE WHEN {_OLD} THEN TIMESTAMP '{S.NOW}' + to_days(30) WHEN id % 2 = 0 THEN NULL ELSE expire_time END, '%Y-%m-%d %H:%M:%S') AS expires FROM documents_"""
)
def deprecate_old(spark, sf_dir):
    docs = S.documents(spark, sf_dir).withColumn("expire_time", F.when(F.col("id") % 2 != 0, F.col("expire_time")))
    found = lifecycle.deprecate_old(docs, docs.where("status = 4"), S.now(), 30)
    return found.select("id", "status", F.date_format("expire_time", "yyyy-MM-dd HH:mm:ss").alias("expires"))


_DIFF = """old AS (SELECT document_id, chunk_index, sha256(content) AS h, chunk_index % 3 > 0 AS vec FROM chunks_),
    new AS (SELECT document_id, chunk_index, sha256(CASE WHEN (document_id + chunk_index) % 5 = 0 THEN content || '!' ELSE content END) AS h FROM chunks_ WHERE chunk_index % 7 < 6
            UNION ALL SELECT doc_id, 100000, sha256('tail') FROM documents),
    both_ AS (SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(o.chunk_index, n.chunk_index) AS chunk_index, o.h AS was, n.h AS now, vec, o.document_id IS NOT NULL AS had, n.document_id IS NOT NULL AS has
              FROM old o FULL JOIN new n ON o.document_id = n.document_id AND o.chunk_index = n.chunk_index),
    diff AS (SELECT document_id, chunk_index, unnest(CASE WHEN NOT has THEN ['stale'] WHEN NOT had THEN ['save'] WHEN was <> now THEN ['save', 'stale'] WHEN NOT vec THEN ['vector_only'] ELSE ['skip'] END) AS cls FROM both_)"""


def _old_and_new(spark, sf_dir):
    rows = S.chunks(spark, sf_dir)
    old = rows.select(
        "document_id", "chunk_index", T.content_hash(F.col("content")).alias("content_hash"),
        F.when(F.col("chunk_index") % 3 > 0, lifecycle.vector_id(F.col("document_id"), F.col("chunk_index"))).alias("vector_id"),
    )
    edited = F.when((F.col("document_id") + F.col("chunk_index")) % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    new = rows.where("chunk_index % 7 < 6").select("document_id", "chunk_index", T.content_hash(edited).alias("content_hash"))
    tail = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(100000).cast("long").alias("chunk_index"), T.content_hash(F.lit("tail")).alias("content_hash"))
    return old, new.unionByName(tail)


@query(S.with_("chunks_") + f", {_DIFF} SELECT document_id, chunk_index, cls FROM diff")
def chunk_diff(spark, sf_dir):
    return lifecycle.chunk_diff(*_old_and_new(spark, sf_dir))


@query(S.with_("chunks_") + f", {_DIFF} SELECT document_id, chunk_index, h AS content_hash, document_id * 1000000 + chunk_index AS vector_id FROM new")
def chunk_diff_apply(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    return lifecycle.apply_diff(old, new, lifecycle.chunk_diff(old, new))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, 7 FROM embeddings WHERE vec_id % 10 = 0")
def keyed_upsert(spark, sf_dir):
    old = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = old.where("id % 3 = 0").select("id", (F.col("label") + 100).alias("label"))
    return keyed.upsert(old, new.union(old.where("id % 10 = 0").select(F.col("id") + 1000000, F.lit(7))), "id")


@query("SELECT doc_id * 1000000 AS id, 0 AS page_no, left(text, 21845) AS text FROM documents")
def store_vectors(spark, sf_dir):
    rows = S.read(spark, sf_dir, "documents").select((F.col("doc_id") * 1000000).alias("id"), F.lit(None).cast("int").alias("page_no"), "text")
    return lifecycle.store_vectors(rows.withColumn("text", F.lit("old")), rows)


@query("SELECT vec_id AS id FROM embeddings WHERE NOT (label = 3 AND vec_id % 4 <> 0)")
def vectors_keep_except(spark, sf_dir):
    vectors = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"))
    keep = vectors.where("id % 4 = 0").select("id")
    return lifecycle.keep_vectors(vectors, keep, spark.createDataFrame([(3,)], "document_id int")).select("id")


@query(S.with_("chunks_") + "SELECT document_id, chunk_index FROM chunks_ WHERE document_id % 3 = 0 OR chunk_index < 3 + document_id % 4")
def vectors_trimmed(spark, sf_dir):
    """Documents that shrank to a few chunks lose the vectors behind them; every third wasn't ingested again."""
    sizes = S.read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), (3 + F.col("doc_id") % 4).alias("n"))
    return lifecycle.trim_vectors(S.chunks(spark, sf_dir).select("document_id", "chunk_index"), sizes)


@query(
    S.with_("documents_", "chunks_", "tasks_")
    + """, gone AS (SELECT id FROM documents_ WHERE status = 4 AND id NOT IN (SELECT document_id FROM tasks_ WHERE status IN (0, 1)))
    SELECT 'documents' AS side, count(*) AS n FROM documents_ WHERE id NOT IN (FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks_ WHERE document_id NOT IN (FROM gone)
    UNION ALL SELECT 'tasks', count(*) FROM tasks_ WHERE document_id NOT IN (FROM gone) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone)"""
)
def cascade_delete(spark, sf_dir):
    docs = S.documents(spark, sf_dir)
    vectors = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    left = lifecycle.delete_documents(docs.where("status = 4").select(F.col("id").alias("document_id")), docs, S.chunks(spark, sf_dir), S.tasks(spark, sf_dir), vectors)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n") for s, t in zip(("documents", "chunks", "tasks", "vectors"), left)]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query(S.with_("permission_") + "SELECT permission_id, code, status FROM permission_ UNION ALL SELECT 98, 'NEW', 1")
def idempotent_seed(spark, sf_dir):
    old = S.permission(spark, sf_dir)
    seed = old.union(spark.createDataFrame([(98, "NEW", 1)], "permission_id int, code string, status int"))
    once = keyed.add_missing(old, seed, "permission_id")
    return keyed.add_missing(once, seed, "permission_id")
