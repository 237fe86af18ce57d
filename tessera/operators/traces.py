"""Conversation traces: windows of context, samples, transitions, groups.

Messages are rows (conv_id, turn, role, text, tool_name, call_id); ``turn`` orders a conversation. Every operator
partitions by conv_id alone, so one shuffle serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.ordinals import running


def conv() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def before() -> WindowSpec:
    return conv().rowsBetween(Window.unboundedPreceding, -1)


def whole() -> WindowSpec:
    return Window.partitionBy("conv_id")


def placed(m: DataFrame) -> DataFrame:
    """pos: a message's place in its conversation, from 0."""
    return m.withColumn("pos", F.row_number().over(conv()) - 1)


def render(role: Column, text: Column, tool: Column) -> Column:
    """P5: one message as chat markup."""
    name = F.when((role == "tool") & tool.isNotNull(), F.concat(F.lit("tool name="), tool)).otherwise(role)
    return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"), X.text(text), F.lit("<|im_end|>"))


def normalized(m: DataFrame) -> DataFrame:
    """Assistants that call tools have no text of their own; messages without text go, unless an assistant's."""
    t = F.when((F.col("role") == "assistant") & F.col("tool_name").isNotNull(), "").otherwise(X.strip(X.text(F.col("text"))))
    known = F.col("role").isin("system", "user", "assistant", "tool")
    checked = F.when(known, t).otherwise(F.raise_error(F.concat(F.lit("role "), F.col("role"))))
    return m.withColumn("text", checked).where((F.col("text") != "") | (F.col("role") == "assistant"))


def call_names(calls: Column) -> Column:
    """Names of tool calls (structs with function.name or name), empty ones left out."""
    return F.filter(F.transform(calls, lambda c: F.coalesce(F.nullif(c["function"]["name"], F.lit("")), c["name"])), lambda n: n.isNotNull() & (n != ""))


def call_ids(m: DataFrame) -> DataFrame:
    """Ids for calls that lack one, from a running number from 0 over all calls in order of (ord, idx)."""
    x, _ = running(m, ["ord", "idx"], name="k__")
    return x.withColumn("call_id", F.coalesce("call_id", F.concat(F.lit("call_"), (F.col("k__") - 1).cast("string")))).drop("k__")


def context(m: DataFrame, last: int) -> DataFrame:
    """(conv_id, turn, c_turn): for each assistant turn the earlier messages that go with it: all of the system's, the
    first of a user, the last ``last`` of any role, and what stands before a tool's message among those."""
    p = placed(m).withColumns({"next_role": F.lead("role").over(conv()), "first_user": F.min(F.when(F.col("role") == "user", F.col("turn"))).over(whole())})
    t = p.where("role = 'assistant'").select("conv_id", F.col("turn").alias("turn"), F.col("pos").alias("t_pos"))
    c = p.select("conv_id", F.col("turn").alias("c_turn"), F.col("pos").alias("c_pos"), "role", "next_role", "first_user")
    near = F.col("t_pos") - F.col("c_pos")
    keep = (F.col("role") == "system") | (F.col("c_turn") == F.col("first_user")) | (near <= last) | ((F.col("next_role") == "tool") & (near - 1 <= last) & (near > 1))
    return t.join(c, "conv_id").where((near > 0) & keep).select("conv_id", "turn", "c_turn")


def turn_samples(m: DataFrame, last: int) -> DataFrame:
    """(conv_id, turn, n_context, prompt, target): an assistant's turn with its context; none without context."""
    c = context(m, last).join(m.select("conv_id", F.col("turn").alias("c_turn"), render(F.col("role"), F.col("text"), F.col("tool_name")).alias("r")), ["conv_id", "c_turn"])
    g = c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_context"), F.array_sort(F.collect_list(F.struct("c_turn", "r"))).alias("rs"))
    g = g.withColumn("prompt", F.array_join(F.transform("rs", lambda x: x["r"]), "\n")).drop("rs")
    return g.join(m.where("role = 'assistant'").select("conv_id", "turn", X.text(F.col("text")).alias("target")), ["conv_id", "turn"])


def full_samples(m: DataFrame) -> DataFrame:
    """(conv_id, n_context, prompt): whole conversations."""
    g = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_context"), F.array_sort(F.collect_list(F.struct("turn", render(F.col("role"), F.col("text"), F.col("tool_name")).alias("r")))).alias("rs"))
    return g.select("conv_id", "n_context", F.array_join(F.transform("rs", lambda x: x["r"]), "\n").alias("prompt"))


def keep_samples(s: DataFrame, text: str, order: list[str], least: int, most: int, allow_duplicate: Column | None = None) -> DataFrame:
    """Samples of fitting length, the first of equal ones; a condition lets duplicates by."""
    h = F.sha2(text, 256)
    fit = s.where((F.length(text) >= least) & ((F.length(text) <= most) if most else F.lit(True)))
    rn = F.row_number().over(Window.partitionBy(h).orderBy(*order))
    return fit.withColumn("rn__", rn).where((F.col("rn__") == 1) | (allow_duplicate if allow_duplicate is not None else F.lit(False))).drop("rn__")


def transitions(m: DataFrame) -> DataFrame:
    """A row for each assistant turn: what was seen before it, the tool call or answer, the call's result
    (the last message of that call id before the id is used again), whether it is the last."""
    p = m.withColumns({"observation": F.lag("text").over(conv()), "is_call": (F.col("role") == "assistant") & F.col("call_id").isNotNull()})
    by_id = Window.partitionBy("conv_id", "call_id").orderBy("turn")
    p = p.withColumn("use", F.when(F.col("call_id").isNotNull(), F.sum(F.col("is_call").cast("int")).over(by_id)))
    res = p.where("role = 'tool' and use > 0").groupBy("conv_id", "call_id", "use").agg(F.max_by("text", "turn").alias("tool_result"))
    a = p.where("role = 'assistant'").withColumn("done", F.lead("turn").over(conv()).isNull())
    out = a.join(res, ["conv_id", "call_id", "use"], "left")
    return out.select("conv_id", "turn", "observation", F.coalesce("tool_name", F.lit("respond")).alias("action"), X.text(F.col("text")).alias("action_text"), "tool_result", "done")


def result_of(m: DataFrame) -> DataFrame:
    """(conv_id, turn, result_turn): a call's result is the first tool message of that name after it, before the next
    assistant, with the same id where both have one."""
    p = placed(m).withColumn("stop", F.first(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(conv().rowsBetween(1, Window.unboundedFollowing)))
    a = p.where("role = 'assistant' and tool_name is not null").select("conv_id", "turn", "tool_name", "call_id", "stop")
    t = p.where("role = 'tool'").select("conv_id", F.col("turn").alias("r_turn"), "tool_name", F.col("call_id").alias("r_id"))
    fits = (F.col("r_turn") > F.col("turn")) & (F.col("stop").isNull() | (F.col("r_turn") < F.col("stop"))) & (F.col("call_id").isNull() | F.col("r_id").isNull() | (F.col("call_id") == F.col("r_id")))
    best = a.join(t, ["conv_id", "tool_name"]).where(fits).groupBy("conv_id", "turn").agg(F.min("r_turn").alias("result_turn"))
    return a.select("conv_id", "turn").join(best, ["conv_id", "turn"], "left")


def segments(m: DataFrame, anchors: list[str], terminals: list[str], within: int, most: int) -> DataFrame:
    """(conv_id, turn, previous_tool, terminal_turn, terminal_tool, end_pos): from a call of an anchor tool to the
    next call of a terminal one within so many messages, with that call's result if it follows, at most ``most`` messages."""
    call = F.when(F.col("role") == "assistant", F.col("tool_name"))
    ahead = conv().rowsBetween(1, within - 1)
    end = F.when(call.isin(terminals), F.struct(F.col("turn").alias("turn"), F.col("pos").alias("pos"), call.alias("tool"), F.coalesce(F.lead("role").over(conv()) == "tool", F.lit(False)).alias("result")))
    p = placed(m).withColumn("end__", end)
    p = p.withColumns({"term__": F.first("end__", ignorenulls=True).over(ahead), "previous_tool": F.last(call, ignorenulls=True).over(before())})
    out = p.where(call.isin(anchors) & F.col("term__").isNotNull())
    stop = F.least(F.col("term__.pos") + 1 + F.col("term__.result").cast("int"), F.col("pos") + most)
    return out.select("conv_id", "turn", "previous_tool", F.col("term__.turn").alias("terminal_turn"), F.col("term__.tool").alias("terminal_tool"), stop.cast("int").alias("end_pos"))


def workflow_weight(m: DataFrame, lookback: int) -> DataFrame:
    """(conv_id, turn, seen, weight): tools used shortly before a call, and a weight by how many."""
    call = F.when(F.col("role") == "assistant", F.col("tool_name"))
    p = m.withColumn("seen", F.size(F.collect_set(call).over(conv().rowsBetween(-lookback, -1))))
    return p.where(call.isNotNull()).select("conv_id", "turn", "seen", F.when(F.col("seen") >= 3, 3).when(F.col("seen") >= 1, 2).otherwise(1).alias("weight"))


def recent_pairs(m: DataFrame, tools: list[str], most: int = 2) -> DataFrame:
    """(conv_id, turn, pair): the last messages that use or answer one of the tools, numbered from the end."""
    p = m.where(F.col("tool_name").isin(tools) & F.col("role").isin("assistant", "tool"))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return p.withColumn("pair", rn).where(F.col("pair") <= most).select("conv_id", "turn", "pair")


#: Tools that gather material, and the tools that name a workflow's end.
RESEARCH_TOOLS = [
    "serper_search",
    "fetch_website_content",
    "fetch_website_content_with_images",
    "fetch_website_images_only",
    "image_search",
    "extract_document_content",
    "file_read",
    "execute_code",
]
IMAGE_TOOL, SAVE_TOOL, REPORT_TOOL, MARK_TOOL = "ask_question_about_image", "file_saver", "generate_markdown_report", "mark_step"


#: Which tools' messages go with a workflow's target.
TRIGGERS = {
    "workflow_image_to_file_saver": (IMAGE_TOOL,),
    "workflow_research_to_file_saver": RESEARCH_TOOLS,
    "workflow_generate_report": (SAVE_TOOL, "file_read"),
    "workflow_mark_after_save_or_report": (SAVE_TOOL, REPORT_TOOL),
}


def workflow_modes(m: DataFrame, lookback: int, weights: dict[str, int]) -> DataFrame:
    """(conv_id, turn, mode, weight) of assistants' calls: what a call ends, by the tools of the ``lookback`` messages before it.
    ``weights`` has file_saver, report and mark_step, each at least 1."""
    used = F.when(F.col("role").isin("assistant", "tool"), F.col("tool_name"))
    p = m.withColumn("recent__", F.collect_set(used).over(conv().rowsBetween(-lookback, -1))).where((F.col("role") == "assistant") & F.col("tool_name").isNotNull())
    saw = lambda *names: F.arrays_overlap("recent__", F.array(*[F.lit(n) for n in names]))
    tool = F.col("tool_name")
    modes = [
        ((tool == SAVE_TOOL) & saw(IMAGE_TOOL), "workflow_image_to_file_saver", "file_saver"),
        ((tool == SAVE_TOOL) & saw(*RESEARCH_TOOLS), "workflow_research_to_file_saver", "file_saver"),
        (tool == SAVE_TOOL, "workflow_file_saver", "file_saver"),
        (tool == REPORT_TOOL, "workflow_generate_report", "report"),
        ((tool == MARK_TOOL) & saw(SAVE_TOOL, REPORT_TOOL), "workflow_mark_after_save_or_report", "mark_step"),
    ]
    mode, weight = F.when(F.lit(False), ""), F.when(F.lit(False), 1)
    for c, name, kind in modes:
        mode, weight = mode.when(c, name), weight.when(c, max(1, weights.get(kind, 1)))
    return p.select("conv_id", "turn", mode.otherwise("").alias("mode"), weight.otherwise(1).alias("weight"))


def recent_tool_pairs(m: DataFrame, tools: list[str], most: int = 2) -> DataFrame:
    """(conv_id, turn): before a conversation's last message, the ``most`` latest messages that call or answer one of the tools, each
    with its neighbour: the assistant's message before an answer, the answer after a call. Call and answer count apart."""
    o = conv()
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    x = m.withColumns({"i__": F.row_number().over(o), "n__": n, "before__": F.lag(F.struct("turn", "role")).over(o), "after__": F.lead(F.struct("turn", "role")).over(o)})
    hit = x.where(F.col("tool_name").isin(tools) & F.col("role").isin("assistant", "tool") & (F.col("i__") < F.col("n__")))
    hit = hit.withColumn("k__", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("i__")))).where(F.col("k__") <= most)
    near = F.when((F.col("role") == "tool") & (F.col("before__.role") == "assistant"), F.col("before__.turn")).when((F.col("role") == "assistant") & (F.col("after__.role") == "tool") & (F.col("i__") + 1 < F.col("n__")), F.col("after__.turn"))
    return hit.select("conv_id", F.explode(F.array_compact(F.array("turn", near))).alias("turn")).distinct()


def workflow_pairs(m: DataFrame, lookback: int, weights: dict[str, int], most: int = 2) -> DataFrame:
    """(conv_id, target, turn): for every target call that ends a workflow (see ``workflow_modes``), the two latest messages
    before it that call or answer one of its mode's trigger tools, each with its neighbour: the assistant's message before an
    answer, the answer after a call. Call and answer count apart.

    A message knows the latest hit before it, and that hit the one before itself, so a conversation is read once."""
    if most != 2:
        raise ValueError("the rule takes two messages")
    o = conv()
    x = m.withColumns({"near__": F.struct(F.lag(F.struct("turn", "role")).over(o).alias("before"), F.lead(F.struct("turn", "role")).over(o).alias("after"))})
    hits, last = {}, {}
    for mode, tools in TRIGGERS.items():
        hit = F.col("role").isin("assistant", "tool") & F.col("tool_name").isin(*tools)
        hits[f"{mode}__"] = F.when(hit, F.struct("turn", "role", "near__"))
    x = x.withColumns(hits)
    x = x.withColumns({f"{k}1": F.last(k, ignorenulls=True).over(before()) for k in hits})
    x = x.withColumns({f"{k}2": F.last(F.when(F.col(k).isNotNull(), F.struct(F.col(f"{k}1").alias("x"))), ignorenulls=True).over(before()) for k in hits})
    for k in hits:
        last[k] = F.array(F.col(f"{k}1"), F.col(f"{k}2.x"))
    found = F.when(F.lit(False), F.array(F.col(f"{next(iter(hits))}1")))
    for mode in TRIGGERS:
        found = found.when(F.col("mode") == mode, last[f"{mode}__"])
    x = x.join(workflow_modes(m, lookback, weights).where("mode <> ''").select("conv_id", "turn", "mode"), ["conv_id", "turn"])
    each = x.select("conv_id", F.col("turn").alias("target"), F.explode(F.array_compact(found)).alias("h"))
    mate = F.when((F.col("h.role") == "tool") & (F.col("h.near__.before.role") == "assistant"), F.col("h.near__.before.turn")).when((F.col("h.role") == "assistant") & (F.col("h.near__.after.role") == "tool"), F.col("h.near__.after.turn"))
    return each.select("conv_id", "target", F.explode(F.array_compact(F.array("h.turn", mate))).alias("turn")).distinct()


def grouped(m: DataFrame) -> DataFrame:
    """Grp: a message and the tools' messages that follow it, from 1."""
    return m.withColumn("grp", F.sum((F.col("role") != "tool").cast("int")).over(conv()))


def truncated(m: DataFrame, most: int, tool_chars: int) -> DataFrame:
    """Messages (conv_id, turn, role, text, tool_name) cut to size: the system's always stay; if there are more than
    ``most`` others, the newest groups that fit, a call with its results in whole or not at all, and results without a call
    before them go; in any case long results are cut to ``tool_chars`` characters and say so. ``place`` is the new order.

    A group that starts with anything but a call is one message, so nothing is left of a group that doesn't fit."""
    talk = F.col("role") != "system"
    heads = talk & (F.col("role") != "tool")
    calls = F.last(F.when(heads, (F.col("role") == "assistant") & F.col("tool_name").isNotNull()), ignorenulls=True).over(before())
    orphan = (F.col("role") == "tool") & ~F.coalesce(calls, F.lit(False))
    x = m.withColumns({"n__": F.count_if(talk).over(whole()), "orphan__": orphan, "grp__": F.sum(heads.cast("int")).over(conv())})
    newer = F.count_if(talk & ~F.col("orphan__")).over(Window.partitionBy("conv_id").orderBy(F.desc("grp__")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("upto__", newer)  # messages of this group and of all newer ones
    x = x.where(~talk | (F.col("n__") <= most) | (~F.col("orphan__") & (F.col("upto__") <= most)))
    told = F.concat(F.left("text", F.lit(tool_chars)), F.lit("\n\n[内容已截断：原始长度 "), F.length("text").cast("string"), F.lit(f" 字符，已截断至 {tool_chars} 字符]"))
    x = x.withColumn("text", F.when((F.col("role") == "tool") & (F.length("text") > tool_chars), told).otherwise(F.col("text")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy((F.col("role") != "system").cast("int"), "turn"))
    return x.withColumn("place", place).drop("n__", "orphan__", "grp__", "upto__")


def keep_last(m: DataFrame, most: int) -> DataFrame:
    """The last messages by whole groups, ``most`` at most; tools' messages without a call before them go. A group of
    one message always fits in whole, so only a call with its results can be too long, and then it goes."""
    g = grouped(m).where("grp > 0")
    n = g.groupBy("conv_id", "grp").agg(F.count(F.lit(1)).alias("n"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("grp")).rowsBetween(Window.unboundedPreceding, 0)
    keep = n.withColumn("upto", F.sum("n").over(back)).where(F.col("upto") <= most).select("conv_id", "grp")
    return g.join(keep, ["conv_id", "grp"], "left_semi")


def keep_budget(m: DataFrame, tokens: int) -> DataFrame:
    """The newest groups whose estimated tokens fit; the first that doesn't ends it."""
    g = grouped(m).withColumn("tok", X.est_tokens(F.col("text")))
    n = g.groupBy("conv_id", "grp").agg(F.sum("tok").alias("n"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("grp")).rowsBetween(Window.unboundedPreceding, 0)
    keep = n.withColumn("upto", F.sum("n").over(back)).where(F.col("upto") <= tokens).select("conv_id", "grp")
    return g.join(keep, ["conv_id", "grp"], "left_semi")


def parts(m: DataFrame, head: int, tail: int) -> DataFrame:
    """Part: head, middle or tail, by groups."""
    g = grouped(m).withColumn("last", F.max("grp").over(whole()))
    return g.withColumn("part", F.when(F.col("grp") <= head, "head").when(F.col("grp") > F.col("last") - tail, "tail").otherwise("middle")).drop("last")


def history(m: DataFrame, last: int = 20, answers: int = 2) -> DataFrame:
    """Of the last messages all of the user's and the last two answers."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rr = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    return m.withColumns({"rn__": rn, "rr__": rr}).where((F.col("rn__") <= last) & ((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("rr__") <= answers)))).drop("rn__", "rr__")


def until(m: DataFrame, stop: Column) -> DataFrame:
    """A conversation up to and with the first message that fulfils the condition."""
    return m.withColumn("hit__", F.coalesce(F.sum(F.coalesce(stop, F.lit(False)).cast("int")).over(before()), F.lit(0))).where("hit__ = 0").drop("hit__")


def counters(m: DataFrame) -> DataFrame:
    """A1: (key, n): statistics by key, one aggregation for all families."""
    call = F.when((F.col("role") == "assistant") & F.col("tool_name").isNotNull(), F.concat(F.lit("tool_call:"), F.col("tool_name")))
    prev = F.last(F.when(F.col("role") == "assistant", F.col("tool_name")), ignorenulls=True).over(before())
    step = F.when(call.isNotNull() & prev.isNotNull(), F.concat(F.lit("workflow_transition:"), prev, F.lit("->"), F.col("tool_name")))
    keys = F.filter(F.array(F.concat(F.lit("role:"), F.col("role")), call, step), lambda k: k.isNotNull())
    return m.withColumn("keys__", keys).select(F.explode("keys__").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def compact_code(lines: DataFrame) -> DataFrame:
    """(doc_id, ln, line): lines equal to the one before, and comments seen before, go."""
    s = X.strip(F.col("line"))
    w = Window.partitionBy("doc_id").orderBy("ln")
    seen = F.row_number().over(Window.partitionBy("doc_id", s).orderBy("ln"))
    out = lines.withColumns({"prev__": F.lag(s).over(w), "seen__": seen})
    return out.where(~F.coalesce(s == F.col("prev__"), F.lit(False)) & ~(s.startswith("#") & (F.col("seen__") > 1))).drop("prev__", "seen__")


def compact_lines(lines: DataFrame, budget: int, keep: str = r"^\s*(?:#|[-*]|\d+\.)|(?i:source|evidence|http)") -> DataFrame:
    """P10: (doc_id, ln, line): each line once (by its first 300 characters), telling ones first come first kept until the
    budget of characters is used; the line that crosses it is kept."""
    once = lines.where(X.strip(F.col("line")) != "").withColumn("k__", F.row_number().over(Window.partitionBy("doc_id", F.left(X.strip(F.col("line")), F.lit(300))).orderBy("ln"))).where("k__ = 1")
    told = once.where(F.col("line").rlike(keep))
    used = F.coalesce(F.sum(F.length("line")).over(Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumn("used__", used).where(F.col("used__") < budget).drop("k__", "used__")
