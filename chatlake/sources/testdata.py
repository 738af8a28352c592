"""The supplied analytics tables seen as message histories.

Every function returns whole tables under the canonical column names; nothing is sampled
or capped. The same expressions are spelled in SQL in ``chatlake.catalog.views``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions import kinds

GROUP_BASE = 1_000_000


@dataclass(frozen=True)
class TestData:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # ------------------------------------------------ customers and orders
    def handles(self) -> DataFrame:
        """Every seventh customer has no contact name."""
        c = self.table("customer")
        address = F.concat(F.lit("+1555"), F.lpad(c.c_custkey.cast("string"), 7, "0"))
        return c.select(
            c.c_custkey.alias("handle_id"),
            address.alias("address"),
            F.when(c.c_custkey % 7 != 0, c.c_name).alias("name"),
            F.regexp_replace(address, "[^0-9]", "").alias("digits"),
        )

    def order_messages(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            o.o_orderkey.alias("message_id"),
            o.o_orderkey.alias("source_id"),
            F.concat(F.lit("o"), o.o_orderkey.cast("string")).alias("guid"),
            o.o_custkey.alias("chat_id"),
            o.o_custkey.alias("handle_id"),
            (o.o_orderstatus == "F").alias("from_me"),
            o.o_orderdate.cast("timestamp").alias("ts"),
            o.o_orderpriority.alias("text"),
            F.when(o.o_orderpriority == "5-LOW", kinds.SYSTEM).otherwise(kinds.TEXT).alias("kind"),
            F.lit(False).alias("edited"),
            F.lit(False).alias("unsent"),
            F.lit(False).alias("has_link"),
        )

    def attachments(self) -> DataFrame:
        l = self.table("lineitem")
        flag, status = l.l_returnflag, l.l_linestatus
        kind = (
            F.when((flag == "R") & (status == "O"), kinds.IMAGE)
            .when((flag == "R") & (status == "F"), kinds.VIDEO)
            .when((flag == "N") & (status == "O"), kinds.AUDIO)
            .when((flag == "N") & (status == "F"), kinds.STICKER)
            .otherwise(kinds.FILE)
        )
        return l.select(
            F.concat_ws("-", l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey).alias("attachment_id"),
            l.l_orderkey.alias("message_id"),
            F.concat(F.lit("IMG_"), l.l_partkey.cast("string")).alias("filename"),
            F.concat(F.lit("/files/"), l.l_suppkey.cast("string"), F.lit("/"), l.l_partkey.cast("string")).alias("path"),
            F.floor(l.l_extendedprice).cast("long").alias("bytes"),
            kind.alias("kind"),
        )

    def file_manifest(self) -> DataFrame:
        """Files that are present: those of lines sold at a discount of five per cent or more."""
        l = self.table("lineitem").filter("l_discount >= 0.05")
        return l.select(
            F.concat(F.lit("/files/"), l.l_suppkey.cast("string"), F.lit("/"), l.l_partkey.cast("string")).alias("path")
        ).distinct()

    def direct_chats(self) -> DataFrame:
        """One 1:1 chat per customer."""
        h = self.handles()
        return h.select(
            h.handle_id.alias("chat_id"),
            h.address.alias("identifier"),
            F.lit(None).cast("string").alias("display_name"),
            F.lit("sms").alias("service"),
        )

    def direct_members(self) -> DataFrame:
        h = self.handles()
        return h.select(h.handle_id.alias("chat_id"), h.handle_id)

    def group_chats(self) -> DataFrame:
        """One group chat per nation; the odd ones are unnamed."""
        n = self.table("nation")
        return n.select(
            (n.n_nationkey + GROUP_BASE).cast("long").alias("chat_id"),
            F.concat(F.lit("chat"), n.n_nationkey.cast("string")).alias("identifier"),
            F.when(n.n_nationkey % 2 == 0, n.n_name).alias("display_name"),
            F.lit("sms").alias("service"),
        )

    def group_members(self) -> DataFrame:
        c = self.table("customer")
        return c.select((c.c_nationkey + GROUP_BASE).cast("long").alias("chat_id"), c.c_custkey.alias("handle_id"))

    def group_messages(self) -> DataFrame:
        """The orders again, told in the customer's nation chat."""
        members = self.group_members().withColumnRenamed("chat_id", "group_id")
        m = self.order_messages()
        return m.join(members, "handle_id").withColumn("chat_id", F.col("group_id")).drop("group_id").select(m.columns)

    # ---------------------------------------------------------------- events
    def event_messages(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            e.event_id.alias("message_id"),
            e.event_id.alias("source_id"),
            F.concat(F.lit("e"), e.event_id.cast("string")).alias("guid"),
            e.user_id.alias("chat_id"),
            e.user_id.alias("handle_id"),
            e.event_type.isin("click", "view").alias("from_me"),
            e.ts.cast("timestamp").alias("ts"),
            e.event_type.alias("text"),
            F.when(e.event_type == "error", kinds.SYSTEM).otherwise(kinds.TEXT).alias("kind"),
            F.lit(False).alias("edited"),
            F.lit(False).alias("unsent"),
            F.lit(False).alias("has_link"),
        )

    def reaction_events(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.expr("event_id div 10").alias("target_id"),
            F.concat(F.lit("e"), F.expr("event_id div 10").cast("string")).alias("target_guid"),
            F.lit(0).cast("long").alias("part"),
            (e.user_id % 3).alias("handle_id"),
            (e.user_id % 3 == 0).alias("from_me"),
            e.event_type.alias("emoji"),
            (e.event_type == "error").alias("removed"),
            e.ts.cast("timestamp").alias("ts"),
            e.event_id.alias("reaction_id"),
        )

    # --------------------------------------------------------- conversations
    def turn_messages(self) -> DataFrame:
        c = self.table("conversations")
        ts = F.timestamp_seconds(F.lit(1704067200) + c.conv_id * 86400 + c.turn * 60)
        return c.select(
            (c.conv_id * 100 + c.turn).alias("message_id"),
            (c.conv_id * 100 + c.turn).alias("source_id"),
            F.concat_ws("-", F.lit("t"), c.conv_id, c.turn).alias("guid"),
            c.conv_id.alias("chat_id"),
            F.when(c.role == "assistant", 1).when(c.role == "system", 2).cast("long").alias("handle_id"),
            (c.role == "user").alias("from_me"),
            ts.alias("ts"),
            c.text,
            F.lit(kinds.TEXT).alias("kind"),
            F.lit(False).alias("edited"),
            F.lit(False).alias("unsent"),
            F.lit(False).alias("has_link"),
            F.lit(0).cast("long").alias("attach_count"),
        )

    def turn_handles(self) -> DataFrame:
        """The roles other than the user, as people."""
        c = self.table("conversations").filter("role <> 'user'")
        return (
            c.select(
                F.when(c.role == "assistant", 1).otherwise(2).cast("long").alias("handle_id"),
                c.role.alias("address"),
            )
            .distinct()
            .withColumn("name", F.lit(None).cast("string"))
            .withColumn("digits", F.lit(None).cast("string"))
        )

    def turn_chats(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(c.conv_id.alias("chat_id")).distinct().withColumn(
            "title", F.concat(F.lit("Conversation "), F.col("chat_id").cast("string"))
        )

    # ------------------------------------------------------------- documents
    def document_messages(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            d.doc_id.alias("message_id"),
            d.doc_id.alias("source_id"),
            F.concat(F.lit("d"), d.doc_id.cast("string")).alias("guid"),
            F.regexp_extract(d.source, r"(\d+)", 1).cast("long").alias("chat_id"),
            (F.ascii(d.lang) * 256 + F.ascii(F.substring(d.lang, 2, 1))).cast("long").alias("handle_id"),
            (d.lang == "en").alias("from_me"),
            F.timestamp_seconds(F.lit(1704067200) + d.doc_id * 60).alias("ts"),
            d.text,
            F.lit(kinds.TEXT).alias("kind"),
            F.lit(False).alias("edited"),
            F.lit(False).alias("unsent"),
            (F.coalesce(d.text.contains("http://") | d.text.contains("https://") | d.text.contains("www."), F.lit(False))).alias("has_link"),
            F.lit(0).cast("long").alias("attach_count"),
        )

    def document_handles(self) -> DataFrame:
        d = self.table("documents")
        return (
            d.select((F.ascii(d.lang) * 256 + F.ascii(F.substring(d.lang, 2, 1))).cast("long").alias("handle_id"), d.lang.alias("address"))
            .distinct()
            .select("handle_id", "address", F.concat(F.lit("Author "), "address").alias("name"), F.lit(None).cast("string").alias("digits"))
        )

    def document_chats(self) -> DataFrame:
        d = self.table("documents")
        chat = F.regexp_extract(d.source, r"(\d+)", 1).cast("long")
        return d.select(chat.alias("chat_id"), d.source.alias("title")).distinct().select(
            "chat_id", "title", F.lit(True).alias("is_group"), F.col("title").alias("display_name")
        )

    def document_members(self) -> DataFrame:
        d = self.document_messages()
        return d.select("chat_id", "handle_id").distinct()
