"""Membership, roles and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.keyed import remove, upsert
from lorespark.sources.tables import ROLE_RANK


def visible(df: DataFrame, members: DataFrame | None, key: str = "kb_id") -> DataFrame:
    """Rows of the knowledge bases in members; None means an administrator, who sees all, and no members none."""
    return df if members is None else df.join(members.select(key), key, "left_semi")


def with_role(members: DataFrame, least: str) -> DataFrame:
    """Memberships of at least this role; unknown roles rank below all."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in ROLE_RANK.items() for x in pair])[F.col("role")], F.lit(0))
    return members.where(rank >= ROLE_RANK[least])


def require(df: DataFrame, members: DataFrame | None, least: str, key: str = "kb_id") -> DataFrame:
    """Rows of the knowledge bases where members (of one user) have at least this role; rows without one are denied.

    None means an administrator, as in visible.
    """
    return df if members is None else visible(df, with_role(members, least), key)


def permissions(user_role: DataFrame, role_permission: DataFrame, permission: DataFrame) -> DataFrame:
    """Distinct (user_id, code) of enabled permissions along user, role and permission."""
    chain = user_role.join(role_permission, "role_id").join(permission.where("status = 1"), "permission_id")
    return chain.select("user_id", "code").distinct()


def admins(user_role: DataFrame, role: DataFrame, code: str = "ADMIN") -> DataFrame:
    return user_role.join(role.where(F.col("code") == code).select("role_id"), "role_id", "left_semi").select("user_id").distinct()


def users_per_role(role: DataFrame, user_role: DataFrame) -> DataFrame:
    """role with n_users, zero for roles that nobody has."""
    counts = user_role.groupBy("role_id").agg(F.count("*").alias("n"))
    return role.join(counts, "role_id", "left").withColumn("n_users", F.coalesce("n", F.lit(0))).drop("n")


def users_with_roles(user: DataFrame, user_role: DataFrame, role: DataFrame) -> DataFrame:
    """user with roles, the sorted codes of its roles joined by commas; empty for a user without any."""
    codes = user_role.join(role, "role_id").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("roles"))
    return user.join(codes, "user_id", "left").withColumn("roles", F.coalesce("roles", F.lit("")))


def roles_of(user: DataFrame, user_role: DataFrame, role: DataFrame) -> DataFrame:
    """user with roles, an array of structs of all columns of role, by role_id; empty for a user without any."""
    own = user_role.join(role, "role_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("role_id", *(c for c in role.columns if c != "role_id")))).alias("roles"))
    joined = user.join(own, "user_id", "left")
    return joined.withColumn("roles", F.coalesce("roles", F.array().cast(own.schema["roles"].dataType)))


def last_owners(members: DataFrame) -> DataFrame:
    """(kb_id, user_id) of owners who are the only one of their knowledge base."""
    owners = members.where("role = 'OWNER'")
    single = owners.groupBy("kb_id").agg(F.count("*").alias("n")).where("n = 1")
    return owners.join(single.select("kb_id"), "kb_id", "left_semi").select("kb_id", "user_id")


def non_members(user: DataFrame, members: DataFrame) -> DataFrame:
    return user.join(members.select("user_id"), "user_id", "left_anti")


def grant(members: DataFrame, grants: DataFrame) -> DataFrame:
    """members after grants (kb_id, user_id, role), but for those that would take the role of a last owner."""
    losing = grants.where("role <> 'OWNER'").join(last_owners(members), ["kb_id", "user_id"], "left_semi")
    return upsert(members, remove(grants, losing, "kb_id", "user_id"), "kb_id", "user_id")


def revoke(members: DataFrame, gone: DataFrame) -> DataFrame:
    """members without gone (kb_id, user_id), last owners excepted."""
    return remove(members, remove(gone, last_owners(members), "kb_id", "user_id"), "kb_id", "user_id")


def overwrite_relation(relation: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """relation with all rows of the owners in new replaced by those of new."""
    return remove(relation, new.select(owner).distinct(), owner).unionByName(new)


def delete_roles(role: DataFrame, user_role: DataFrame, role_permission: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the roles (role_id) in gone; ADMIN stays."""
    gone = gone.join(role.where("code <> 'ADMIN'").select("role_id"), "role_id", "left_semi")
    return tuple(remove(t, gone, "role_id") for t in (role, user_role, role_permission))


def deletable_users(user: DataFrame, members: DataFrame, user_role: DataFrame, role: DataFrame) -> DataFrame:
    """Users who are neither last owner of a knowledge base nor the last administrator."""
    admin = admins(user_role, role)
    last = admin.join(admin.agg(F.count("*").alias("n")).where("n = 1"), how="left_semi")
    return remove(remove(user, last_owners(members), "user_id"), last, "user_id")


def delete_users(
    user: DataFrame, members: DataFrame, user_role: DataFrame, role: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """user, members and user_role without the users (user_id) in gone that may be deleted."""
    gone = gone.select("user_id").join(deletable_users(user, members, user_role, role).select("user_id"), "user_id", "left_semi")
    return tuple(remove(t, gone, "user_id") for t in (user, members, user_role))


#: Roles of one code, at most, that get every permission.
SEEDED = 1000


def seed_permissions(role: DataFrame, permission: DataFrame, role_permission: DataFrame, code: str = "ADMIN") -> DataFrame:
    """Rows that role_permission lacks for the roles of a code, SEEDED at most, to have every permission."""
    roles = [r[0] for r in role.where(F.col("code") == code).select("role_id").limit(SEEDED + 1).collect()]
    if len(roles) > SEEDED:
        raise ValueError(f"more than {SEEDED} roles have the code {code}")
    each = F.explode(F.array(*map(F.lit, roles)).cast(f"array<{role.schema['role_id'].dataType.simpleString()}>"))
    pairs = permission.select(each.alias("role_id"), "permission_id")
    return remove(pairs, role_permission, "role_id", "permission_id")


def audit(log: DataFrame, events: DataFrame, limit: int = 500) -> DataFrame:
    """log with events appended, their details cut to limit characters."""
    return log.unionByName(events.withColumn("detail", F.substring("detail", 1, limit)))
