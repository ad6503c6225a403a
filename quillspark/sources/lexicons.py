"""Word lists and patterns of the detectors: built-in fixed values, replaced as a whole by a JSON file of the same schema.

The file maps each name of DEFAULT to its value. Names that it doesn't hold keep the built-in one.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

# Phrases, patterns, thresholds and weights that detection results depend on.
DEFAULT: dict = {
    "critical_regex": [
        r"首先[，,].*?其次[，,].*?最后",
        r"一方面[，,].*?另一方面",
        r"第一[，,].*?第二[，,].*?第三",
        r"其一[，,].*?其二[，,].*?其三",
    ],
    "mechanical_connectors": [
        "值得注意的是", "综上所述", "不难发现", "总而言之", "与此同时", "在此基础上", "由此可见", "不仅如此",
        "换句话说", "更重要的是", "需要强调的是", "不可否认", "显而易见", "不言而喻", "正如我们所知", "归根结底",
    ],
    "empty_grand_words": [
        "赋能", "闭环", "智慧时代", "数字化转型", "生态", "愿景", "顶层设计", "协同增效", "降本增效", "打通壁垒",
        "深度融合", "创新驱动", "全方位", "多维度", "系统性",
    ],
    "ai_high_freq_words": [
        "助力", "彰显", "凸显", "焕发", "深度剖析", "加持", "赛道", "破圈", "出圈", "颠覆", "革新",
        "底层逻辑", "抓手", "链路", "触达", "心智", "沉淀", "对齐", "拉通", "复盘", "迭代",
    ],
    "filler_phrases": ["值得一提的是", "需要指出的是", "不得不说", "毫无疑问", "众所周知", "正因如此", "具体来说", "简而言之", "换言之"],
    "balanced_arguments": [r"虽然.*?但是.*?同时", r"一方面.*?另一方面.*?总的来说"],
    "template_sentences": [
        r"随着.*?的(不断)?发展", r"在.*?的背景下", r"在当今.*?时代", r"作为.*?的重要(组成部分|环节|手段)", r"对于.*?而言[，,].*?至关重要",
        r"这不仅.*?更是", r"从.*?角度(来看|来说|而言)", r"无论是.*?还是.*?都", r"可以说[，,]", r"总的来说[，,]",
    ],
    "hedging": ["在一定程度上", "或许", "某种程度上", "相对而言", "总体来说", "一般来说", "通常情况下"],
    "hedging_threshold": 5,
    "emotional_words": [
        "愤怒", "高兴", "难过", "失望", "惊讶", "担心", "开心", "郁闷", "焦虑", "兴奋", "害怕", "感动",
        "烦躁", "痛苦", "崩溃", "无奈", "委屈", "舒服",
    ],
    "personal_markers": ["我觉得", "我认为", "我个人", "在我看来", "说实话", "坦白讲", "老实说", "不瞒你说"],
    "list_patterns": [r"(?:(?:①|②|③|④|⑤).*?\n){3,}", r"(?:(?:\d\.)\s.*?\n){3,}", r"(?:(?:[-•·])\s.*?\n){4,}"],
    "parallel_pattern": r"[，,][^，,。！？]{4,10}[；;，,][^，,。！？]{4,10}[。！？]",
    "severity_weights": {"critical": 8, "high": 4, "medium": 2, "style": 1.5},
    "statistical_weights": {
        "stat_low_sentence_length_cv": 14, "stat_low_short_sentence_fraction": 12, "stat_high_transition_density": 8, "stat_high_curvature": 6,
        "stat_low_binoculars_diff": 6, "stat_low_char_mattr": 8, "stat_low_perplexity": 10, "stat_high_top10_bucket": 10, "stat_low_surprisal_skew": 9,
        "stat_low_comma_density": 8, "stat_low_surprisal_kurt": 6, "stat_low_burstiness": 3, "stat_uniform_entropy": 2, "stat_low_para_sent_len_cv": 10,
    },
    "transitions": [
        "首先", "其次", "再次", "最后", "然后", "接下来", "与此同时",
        "综上所述", "总的来说", "总而言之", "归根结底", "由此可见", "一方面", "另一方面", "换言之", "简而言之",
        "值得注意的是", "需要指出的是", "需要强调的是", "不可否认", "尤其是", "特别是", "尤为", "显著",
        "然而", "不过", "相反", "相较而言", "与之相对", "反之", "反观", "诚然", "固然", "纵然", "尽管如此",
        "因此", "所以", "故而", "由此", "进而", "从而", "基于此",
        "此外", "另外", "除此之外", "具体而言", "具体来说", "具体地说", "举例来说", "举个例子", "更进一步", "进一步", "事实上", "实际上", "实质上", "本质上",
        "或许", "不妨", "也许", "大致", "大概", "某种程度上", "一定程度上", "可能", "应当", "应该", "理论上",
        "需要注意", "需要说明", "值得一提", "请注意",
    ],
    "academic_phrases": [
        "本文旨在", "研究表明", "具有重要意义", "进行了深入分析", "具有重要的理论意义和实践价值", "为此本文", "鉴于此", "对此进行了系统的",
        "进行了全面的分析", "进行了系统的研究", "取得了显著的成效", "具有广阔的应用前景", "发挥着重要作用", "引起了广泛关注", "得到了广泛的应用",
        "提供了有力的支撑", "提出了切实可行的", "进行了有益的探索", "奠定了坚实的基础", "提供了重要的参考价值", "提供了新的思路", "开辟了新的途径",
        "进行了详细的阐述", "做出了重要贡献", "具有一定的参考价值", "受到了学术界的广泛关注", "成为学术界研究的热点", "具有十分重要的现实意义",
        "有着不可忽视的作用", "对其进行深入研究", "有待进一步研究",
    ],
    "passive_patterns": [
        r"被广泛(应用|使用|采用|运用|关注|认可|接受)", r"被认为是", r"被(视为|看作|称为|誉为)", r"被(普遍|学界|学术界|研究者)(认为|接受|采纳)",
        r"被(充分|有效|合理)(利用|运用|开发)", r"被(证明|证实|验证)(为|是)", r"受到了?(广泛|高度|普遍|学界的?)(关注|重视|认可)",
    ],
    "paragraph_openers": [
        r"^(总的来看|总体而言|概括来说|从总体上看)", r"^(在\S{2,8}方面)", r"^(就\S{2,8}而言)", r"^(关于\S{2,8}(的问题|方面|层面))", r"^(从\S{2,8}(角度|视角|层面)(来看|来说|出发))",
    ],
    "logic_connectors": [
        "因此", "所以", "由此可见", "综上所述", "总而言之", "此外", "另外", "与此同时", "不仅如此", "更重要的是", "换言之", "也就是说",
        "具体而言", "进而", "从而", "然而", "但是", "不过", "尽管如此", "相比之下", "一方面", "另一方面", "首先", "其次", "最后",
        "事实上", "实际上", "显然", "毫无疑问", "值得注意的是", "需要指出的是", "值得一提的是", "由此", "基于此",
    ],
    "academic_repeat_words": [
        "研究", "分析", "探讨", "论述", "阐述", "表明", "发现", "指出", "认为", "提出", "进行", "开展", "影响", "作用", "意义",
        "价值", "问题", "方面", "水平", "能力", "效果", "结果", "方法", "策略", "措施", "途径", "机制", "模式", "体系", "框架",
    ],
    "citation_templates": [
        r"[（(]\d{4}[）)]指出", r"[（(]\d{4}[）)]认为", r"[（(]\d{4}[）)]的研究(表明|发现|指出|证实)", r"根据\S{1,6}[（(]\d{4}[）)]的研究",
        r"正如\S{1,6}[（(]\d{4}[）)]所(指出|述|言)", r"\S{1,6}等[（(]\d{4}[）)](的研究)?(表明|发现|认为)",
    ],
    "citation": r"[（(]\d{4}[）)]",
    "data_templates": [
        "数据显示", "数据表明", "从表中可以看出", "如表所示", "从图中可以看出", "如图所示", "由表可知", "由图可知", "根据表中数据", "从上表可以看出",
        "通过数据分析可知", "统计结果表明", "分析结果显示", "实验结果表明", "调查结果显示", "从数据中不难发现", "数据分析结果表明", "表中数据表明", "从图表中可以清晰地看出",
    ],
    "enumerations": [
        r"(?:(?:①|②|③|④|⑤|⑥).*?[。；;]){3,}", r"(?:(?:第[一二三四五六七八九十])[，,].*?[。；;]){3,}", r"(?:(?:\([一二三四五六]\)).*?[。；;]){3,}", r"(?:(?:\d\.)\s*.*?[。；;]){4,}",
    ],
    "perfect_conclusions": [
        "取得了显著成效", "取得了丰硕成果", "取得了重大突破", "圆满完成", "成效显著", "效果明显", "成果丰硕", "为.*?提供了有力支撑", "为.*?奠定了坚实基础",
        "具有重要的理论意义和实践价值", "前景广阔",
    ],
    "limitations": ["局限", "不足", "有待", "仍需", "尚未", "尚需", "未来研究", "后续研究", "进一步探讨", "存在一定的", "样本量", "推广性", "外部效度", "内部效度"],
    "certainty": ["必然", "一定会", "毫无疑问", "无疑", "显然", "毋庸置疑", "不可否认", "确定无疑", "势必", "必将", "注定", "无一例外", "绝对"],
    "academic_hedges": ["可能", "或许", "也许", "在一定条件下", "在某种程度上", "一般而言", "通常", "大致", "似乎", "倾向于", "有可能", "在一定范围内", "初步", "大体上"],
    "dimension_weights": {
        "ai_academic_phrases": 8, "passive_overuse": 5, "paragraph_uniformity": 6, "connector_density": 7, "synonym_poverty": 6, "citation_integration": 4,
        "data_template": 5, "over_enumeration": 5, "perfect_conclusion": 6, "certainty_overuse": 7, "low_topic_diffusion": 5,
    },
    "severity_factors": {"critical": 1.5, "high": 1.0, "medium": 0.6, "low": 0.3},
    "academic_statistical_weights": {
        "stat_low_sentence_length_cv": 14, "stat_low_short_sentence_fraction": 12, "stat_low_perplexity": 12, "stat_low_burstiness": 10, "stat_low_comma_density": 8, "stat_uniform_entropy": 8,
    },
    "academic_scene_markers": [
        "本研究", "研究表明", "理论意义", "实践价值", "研究发现", "研究结果", "研究对象", "研究方法", "文献综述", "实证分析", "理论框架", "学术价值",
        "现实意义", "实践意义", "变量", "样本", "模型", "假设",
    ],
    "route_strong": ["本文", "本研究", "笔者", "摘要", "参考文献", "文献综述"],
    "route_weak": ["研究表明", "综上所述", "实验", "文献", "样本", "显著", "机制"],
    "route_social": ["姐妹", "宝子", "家人们", "！！", "绝了", "冲鸭", "笔记", "安利", "种草", "打卡", "分享一个"],
    "guard_fillers": [
        r"不仅[^，。；]{0,12}更是", r"与其说[^，。；]{0,12}不如说", r"真正的[^，。；]{0,10}是", r"这不只是[^，。；]{0,12}这是",
        r"标志着", r"体现了", r"见证了", r"具有重要(的)?(意义|价值)", r"将重新定义", r"为[^，。；]{0,12}提供了有力支撑", r"注入新的活力", r"开创[^，。；]{0,10}新局面", r"广阔的发展前景",
        r"赋能", r"助力", r"致力于", r"匠心", r"极致", r"深度融合", r"全方位(地)?", r"多维度(地)?", r"闭环", r"抓手", r"协同增效", r"高质量发展", r"新质生产力", r"数字化转型",
        r"综上所述", r"总而言之", r"归根结底", r"值得注意的是", r"不难发现", r"换句话说", r"与此同时", r"由此可见", r"不言而喻", r"众所周知", r"不可否认", r"值得一提的是", r"我们有理由相信",
        r"先说结论", r"一句话总结", r"说白了", r"简单来说", r"划重点",
        r"未来可期", r"让我们拭目以待", r"前景广阔", r"任重而道远", r"开创更加美好的未来",
        r"随着[^，。；]{0,14}的不断发展", r"在当今[^，。；]{0,12}的时代", r"在[^，。；]{0,12}的背景下", r"作为[^，。；]{0,12}的重要组成部分",
        r"首先[，、]", r"其次[，、]", r"最后[，、]", r"一方面[，、]", r"另一方面[，、]", r"第一[，、]", r"第二[，、]", r"第三[，、]",
    ],
    "preamble": r"^\s*(以下是|这是|好的|改写后|修改后)",
    "sentence_initial": [
        "但是", "但", "不过", "然而", "可是", "只是", "所以", "因此", "于是", "结果", "这样", "另外", "此外", "同时", "而且", "并且",
        "后来", "接着", "随后", "然后", "最终", "最后", "反过来", "相反", "换个说法",
    ],
    "subordinators": [
        "虽然", "尽管", "固然", "因为", "由于", "既然", "如果", "假如", "倘若", "要是", "即使", "即便", "哪怕", "无论", "不管", "不论",
        "只有", "只要", "除非", "一旦", "为了", "以便", "以免", "与其", "宁可", "不但", "不仅",
    ],
    "dependent_heads": [
        "通过", "经过", "根据", "按照", "依据", "依照", "本着", "鉴于", "借助", "凭借", "利用", "运用", "采用", "结合", "基于", "面向",
        "围绕", "针对", "关于", "对于", "至于", "就", "随着", "伴随", "为了", "出于", "考虑到", "受限于", "得益于", "在",
    ],
    "rhythm_punctuation": "。，、；：！？…—－·「」『』（）()《》〈〉“”‘’\"'\n\r\t ",
    "function_words": ["的", "了", "是", "在", "和", "与", "及", "也", "都", "就", "但", "而", "或", "又", "所", "以"],
    "formal_to_casual": {
        "首先": "", "其次": "再说", "最后": "最后", "值得注意的是": "注意", "综上所述": "总之", "不难发现": "可以看到", "总而言之": "总的来说",
        "与此同时": "同时", "在此基础上": "基于这个", "由此可见": "所以", "此外": "另外", "因此": "所以", "并且": "而且", "不可否认": "确实",
        "显而易见": "明摆着", "不言而喻": "不用说", "毋庸置疑": "肯定的是",
    },
    "casual_to_formal": {"很": "较为", "特别": "尤其", "挺": "相对", "蛮": "较为", "说实话": "", "确实": "", "讲真": "", "没想到": "", "说起来": "", "你看": ""},
    "novel_artifacts": [r"我将按照您的", r"按照您的要求", r"根据您(供给|提供)的", r"以下是我(根据|为您|按照)", r"故事梗概", r"本次写作(重点|将|主要)", r"接下来故事(可能|将|会)", r"这是一个关于.{0,20}的故事"],
    "legit_repeats": ["一[一-鿿]一[一-鿿]", "[一-鿿]来[一-鿿]去", "[一-鿿]前[一-鿿]后", "[一-鿿]+又[一-鿿]+", "越[一-鿿]越[一-鿿]", r"[一-鿿]([一-鿿])\1"],
    "common_bigrams": [
        "我们", "他们", "可以", "我的", "你的", "一个", "一种", "一些", "这个", "这些", "那个", "那些", "什么", "怎么", "因为", "所以", "但是", "如果", "虽然", "因此",
        "然后", "现在", "已经", "正在", "可能", "应该", "需要", "能够", "通过", "关于", "对于", "由于", "不是", "就是", "还有", "或者", "比如", "这样",
        "那样", "其实", "其中", "其他", "自己", "大家", "一直", "总是", "从来", "从未", "没有", "不过", "而且", "并且", "以及", "而是", "尽管", "只是", "只有",
        "只要", "为了", "在于", "说明", "表示", "认为", "觉得", "感觉", "希望", "想要", "了一", "一下", "了解", "不仅", "在这", "这种", "研究", "工作", "问题",
        "时候", "时间", "方面", "方法", "方式", "过程", "阶段", "形成", "出现", "存在", "发展", "提高", "增加", "减少", "改变", "影响", "促进", "推动", "实现", "完成",
    ],
    "candidate_bans": ["另一边", "以此达到", "这里有一个值得关注的细节"],
}

# Own values: replacement candidates of this package, of the schema {pattern: [candidates]}
DEFAULT["replacements"] = {
    "总而言之": ["总之", "说到底"], "综上所述": ["总的看", "归纳起来"], "值得注意的是": ["要留意", "注意"], "不难发现": ["可以看到", "能看出"],
    "由此可见": ["可见", "这说明"], "与此同时": ["同时", "这时"], "需要指出的是": ["要说明的是", "要提一句"], "在此基础上": ["接着", "再往下"],
    "毫无疑问": ["肯定", "没什么疑问"], "众所周知": ["大家知道", "都知道"],
}
DEFAULT["academic_replacements"] = {"具有重要的理论意义和实践价值": ["在理论和实践上都有用处"], "研究表明": ["已有研究显示", "研究发现"]}


def load(path: str | os.PathLike | None = None) -> dict:
    """The lexicons of a JSON file over the built-in ones; without a file, or where it doesn't exist, the built-in ones."""
    if path is None or not Path(path).exists():
        return dict(DEFAULT)
    own = json.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := set(own) - set(DEFAULT):
        raise ValueError(f"unknown lexicons: {', '.join(sorted(unknown))}")
    return DEFAULT | own
