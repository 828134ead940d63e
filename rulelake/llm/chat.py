"""Preference formatting of chosen and rejected conversations.

A pair's longest common prefix of turns is rendered once as the prompt; what follows is
each side's completion. A completion's mask lists the character ranges that are trained on:
the contents of its assistant turns, never headers or other roles. All built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TURN = "array<struct<role: string, text: string>>"


def _render(turns: str) -> str:
    mid, close = MIDDLE.replace("\n", "\\n"), CLOSE.replace("\n", "\\n")
    return f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '{mid}', t.text, '{close}')), '')"


def _mask(turns: str) -> str:
    """start:end of each assistant turn's text within the rendered turns, comma-joined; offsets in characters."""
    head = f"{len(OPEN)} + char_length(t.role) + {len(MIDDLE)}"
    fold = (
        f"aggregate({turns}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, t) -> named_struct("
        f"'at', a.at + {head} + char_length(t.text) + {len(CLOSE)}, "
        f"'out', if(t.role = 'assistant', concat(a.out, array(concat(a.at + {head}, ':', a.at + {head} + char_length(t.text)))), a.out)), a -> a.out)"
    )
    return f"array_join({fold}, ',')"


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs (with two arrays of struct<role, text>) plus the formatted record.

    Adds ``n_common, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask`` and keeps all
    columns but the two arrays. A null array is empty, a null role is ``user`` and a null text empty.
    Equal conversations have empty completions; without a common turn the prompt is empty.
    """
    made = ("n_common", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask")
    rest = [c for c in pairs.columns if c not in (chosen, rejected, *made)]
    clean = lambda c: f"transform(coalesce(`{c}`, cast(array() as {TURN})), t -> named_struct('role', coalesce(t.role, 'user'), 'text', coalesce(t.text, '')))"
    df = pairs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(rest)], F.expr(clean(chosen)).alias("_c"), F.expr(clean(rejected)).alias("_r"))
    both = "zip_with(_c, _r, (a, b) -> a is not null and b is not null and a.role = b.role and a.text = b.text)"
    df = df.withColumn("_same", F.expr(both))
    df = df.withColumn("n_common", F.expr("if(size(_same) = 0, 0, if(array_position(_same, false) = 0, size(_same), cast(array_position(_same, false) - 1 as int)))"))
    df = df.withColumns({"_ct": F.expr("slice(_c, n_common + 1, greatest(size(_c) - n_common, 0))"), "_rt": F.expr("slice(_r, n_common + 1, greatest(size(_r) - n_common, 0))")})
    texts = {"prompt": _render("slice(_c, 1, n_common)"), "chosen_text": _render("_ct"), "rejected_text": _render("_rt"), "chosen_mask": _mask("_ct"), "rejected_mask": _mask("_rt")}
    return df.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(rest)], "n_common", *[F.expr(e).alias(k) for k, e in texts.items()])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from conversations (conv_id, turn, role, text): each conversation as chosen and another one as rejected.

    The rejected one begins with the same turn: of those conversations that have an id the one of the least, or for that
    one itself the one of the greatest. A conversation that begins like no other is answered by itself: its turns before the last
    assistant turn, then its first assistant turn's text, or an empty text where that is the last; without an
    assistant turn by nothing but itself. ``rejected_id`` names the other conversation, null for its own.

    Turns are ordered by (turn, role, text); repeated turns stay. A null role is ``user``, a null text empty. A turn
    without conv_id is a conversation of its own. An empty table gives no rows. A conversation is one record, so its
    own turns are gathered; of those that begin alike only the first and the last are.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = turns.select("conv_id", turn.alias("_x"))
    one = named.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("_x")).alias("_t"))
    one = one.unionByName(named.where("conv_id is null").select("conv_id", F.array("_x").alias("_t")))
    one = one.select("conv_id", F.expr("transform(_t, t -> named_struct('role', t.role, 'text', t.text))").alias("chosen")).withColumn("_key", F.unhex(F.sha2(F.expr("concat(chosen[0].role, char(0), chosen[0].text)"), 256)))
    named_one = F.when(F.col("conv_id").isNotNull(), F.struct("conv_id", "chosen"))
    ends = one.groupBy("_key").agg(F.min(named_one).alias("_low"), F.max(named_one).alias("_high"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    both = one.join(ends, "_key", "left")
    first = F.col("_low.conv_id").eqNullSafe(F.col("conv_id"))
    both = both.withColumn("_other", F.when(~first, F.col("_low")).when(F.col("_high.conv_id") != F.col("_low.conv_id"), F.col("_high")))
    both = both.withColumn("_a", F.expr("filter(transform(chosen, (t, i) -> if(t.role = 'assistant', i, -1)), i -> i >= 0)"))
    reply = "if(size(_a) > 1, chosen[_a[0]].text, '')"
    own = F.expr(f"if(size(_a) = 0, chosen, concat(slice(chosen, 1, element_at(_a, -1)), array(named_struct('role', 'assistant', 'text', {reply}))))")
    return both.select("conv_id", F.col("_other.conv_id").alias("rejected_id"), "chosen", F.when(F.col("_other").isNotNull(), F.col("_other.chosen")).otherwise(own).alias("rejected"))


def op10_preferences(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_preferences(preference_pairs(turns))


OP10_SQL = """
with t as (select conv_id, coalesce(role, 'user') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) as i from conversations where conv_id is not null),
k as (select conv_id, role, text from t where i = 1),
e as (select role, text, min(conv_id) as low, max(conv_id) as high from k group by all),
o as (select k.conv_id, case when e.low = e.high then null when k.conv_id = e.low then e.high else e.low end as other from k join e using (role, text)),
a as (select conv_id, max(case when role = 'assistant' then i end) as l, min(case when role = 'assistant' then i end) as f from t group by conv_id),
r as (select o.conv_id, t.i, t.role, t.text from o join t on t.conv_id = o.other
  union all select o.conv_id, t.i, t.role, case when t.i = a.l then case when a.f < a.l then (select x.text from t x where x.conv_id = o.conv_id and x.i = a.f) else '' end else t.text end
  from o join a on a.conv_id = o.conv_id join t on t.conv_id = o.conv_id where o.other is null and (a.l is null or t.i <= a.l)),
d as (select coalesce(t.conv_id, r.conv_id) as conv_id, min(coalesce(t.i, r.i)) filter (t.conv_id is null or r.conv_id is null or t.role <> r.role or t.text <> r.text) as first,
    count(*) as n from t full join r on r.conv_id = t.conv_id and r.i = t.i group by 1),
c as (select conv_id, coalesce(first - 1, n) as c from d),
s as (select 'c' as side, t.conv_id, t.i, t.role, t.text, c.c from t join c using (conv_id) union all select 'r', r.conv_id, r.i, r.role, r.text, c.c from r join c using (conv_id)),
w as (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line from s),
m as (select *, coalesce(sum(length(line)) over (partition by side, conv_id order by i rows between unbounded preceding and 1 preceding), 0) + length(role) + 5 as pos from w where i > c),
p as (select conv_id, string_agg(line, '' order by i) as prompt from w where side = 'c' and i <= c group by 1),
g as (select side, conv_id, string_agg(line, '' order by i) as text,
    string_agg(case when role = 'assistant' then cast(cast(pos as bigint) as varchar) || ':' || cast(cast(pos + length(text) as bigint) as varchar) end, ',' order by i) as mask from m group by 1, 2)
select c.conv_id, o.other as rejected_id, cast(c.c as int) as n_common, coalesce(p.prompt, '') as prompt, coalesce(x.text, '') as chosen_text, coalesce(y.text, '') as rejected_text,
    coalesce(x.mask, '') as chosen_mask, coalesce(y.mask, '') as rejected_mask
from c join o using (conv_id) left join p using (conv_id) left join g x on x.side = 'c' and x.conv_id = c.conv_id left join g y on y.side = 'r' and y.conv_id = c.conv_id"""
