"""Small documents of our own in Han script, and pairs, votes and hygiene cases, the same text in both engines."""

HAN = (
    (1, ""), (2, "   "), (3, "短文一句"), (4, "首先我们看看天气。其次我们去公园。最后大家一起回家。然而雨下得很大，于是只好等待。总而言之今天很好。"),
    (5, "因此这个方法很好。因此那个方法也好。因此我们都用它。因此大家都满意。因此没有问题。因此到此为止。"),
    (6, "早上，小河边有三只鸭子。\n它们慢慢地游过来，又慢慢地游走了，谁也不知道它们要去哪里！\n天黑以后鸭子回家。你看见了吗？\n我没有看见，可是他说他看见了；也许是真的。"),
    (7, "研究表明，该模型在一定程度上可能有效（2019）。研究表明，数据显示结果显著（2020）。综上所述，本文提出的方法具有重要意义。或许仍有局限。"),
    (8, "他说：“今天花了1,200元，占60%。”然后他打开GPT-4和iPhone，写了三行字。值得注意的是，价格没有变。"),
    (9, "一方面要快，另一方面要稳；一方面省钱，另一方面省力——这就是目标。值得注意的是，进一步提升需要时间。"),
)
HYGIENE = ((1, "干净的文字"), (2, "零​宽​字"), (3, "﻿开头"), (4, "不 断 行　全角保留"), (5, "方‮向"), (6, "私用"), (7, "康⼀熙"), (8, ""))
PAIRS = (
    (1, "同样的一句话没有变化", "同样的一句话没有变化"), (2, "甲乙丙丁戊己庚辛", "子丑寅卯辰巳午未"), (3, "空 白 不 算 数 的 例 子", "空白不算数的例子"),
    (4, "前一半留下来后一半不见了", "前一半留下来"), (5, "价格是1,200元，用GPT-4写", "价格是1300元，用人写"), (6, "原文很短", ""), (7, "第一段。\n\n第二段。", "第一段。第二段。"),
)
VOTES = (
    (1, "a", 4, "句子一"), (1, "b", 5, "句子一"), (1, "c", 3, "句子"), (2, "a", 2, "别处"), (2, "b", 4, "文中"), (2, "c", 4, "没有"), (3, "a", 5, ""), (3, "b", 5, ""), (3, "c", 5, ""),
)
VOTED = ((1, "这里有句子一和别的"), (2, "文中也有"), (3, "好"))


def values(rows: tuple, names: str) -> str:
    """A VALUES query; texts hold neither quotes nor backslashes."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS v({names})"
