"""Fixed values of the review domain."""

from __future__ import annotations

# Dimensions and their error types.
ERROR_TYPES = {
    "C2.1": ["E-S-01", "E-S-02", "E-S-03", "E-S-04", "E-S-05", "E-S-06"],
    "C2.2": ["E-SC-01", "E-SC-02", "E-SC-03"],
    "C3.1": ["E-T-01", "E-T-02", "E-T-03", "E-T-04", "E-T-05", "E-T-06", "E-T-07"],
    "C3.2": ["E-TM-01", "E-TM-02", "E-TM-03", "E-TM-04", "E-TM-05"],
    "C3.3": ["E-R-01", "E-R-02", "E-R-03", "E-R-04"],
}
# Error types that are suggested beside one that was found.
RELATED_TYPES = {
    ("C2.1", "E-S-02"): ["E-S-03"],
    ("C2.1", "E-S-03"): ["E-S-02"],
    ("C3.1", "E-T-01"): ["E-T-02", "E-T-03", "E-T-07"],
    ("C3.1", "E-T-02"): ["E-T-01", "E-T-07"],
    ("C3.1", "E-T-03"): ["E-T-01", "E-T-07"],
    ("C3.1", "E-T-07"): ["E-T-01", "E-T-02", "E-T-03"],
    ("C3.2", "E-TM-01"): ["E-TM-03", "E-TM-04"],
    ("C3.2", "E-TM-03"): ["E-TM-01", "E-TM-04"],
    ("C3.2", "E-TM-04"): ["E-TM-01", "E-TM-03"],
    ("C3.3", "E-R-03"): ["E-R-01", "E-R-02"],
}
# Dimensions whose findings spread to neighbouring sections.
SPREADING = ["C2.2", "C3.1", "C3.2", "C3.3"]
# Modal words in their order, and the high-risk ones.
MODALS = ["不应", "不宜", "必须", "须", "应", "宜", "可", "尽量", "最好", "一般", "原则上", "必要时"]
RISKY_MODALS = ["不应", "不宜", "必须", "须", "尽量", "最好", "一般", "原则上", "必要时", "适当", "可", "宜"]
# Prefixes of standards in reviews, and of those that injectors know.
STANDARD_PREFIXES = ["GB/T", "GB", "ISO/IEC", "ISO", "IEC", "DL/T", "HG/T", "SN/T", "GA/T", "JJF", "JJG", "YD/T", "JB/T", "IEEE", "ASTM"]
INJECTED_PREFIXES = ["GB", "GB/T", "IEC", "ISO", "YD/T", "JG/T", "HJ", "QB", "SJ", "JB", "NB"]
# Headings without a number.
PLAIN_HEADINGS = ["前言", "前  言", "引言", "引  言", "参考文献", "目次", "目录"]
TOOL_HEADINGS = ["前言", "前  言", "引言", "引  言", "目次", "目  次", "参考文献", "参 考 文 献"]
# Keywords of technical sections.
TECHNICAL_TITLES = ["要求", "技术要求", "试验方法", "检验规则", "检测方法", "判定规则", "标志", "包装", "运输", "贮存"]
TECHNICAL_WORDS = ["限值", "指标", "单位", "试样", "样品", "设备", "步骤", "计算", "结果", "判定", "应符合", "按", "进行"]
TERM_WORDS = ["定义", "称为", "是指", "表示", "用于", "由", "组成"]
# Sections that must be there, by keyword; other names of standard titles; their order and depth.
MANDATORY = {"前言": ["前言", "前  言"], "范围": ["范围"], "规范性引用文件": ["规范性引用文件"], "术语和定义": ["术语和定义", "术语"]}
WRONG_TITLES = {
    "前言": ["序言", "说明", "编制说明", "前  言", "标准前言"],
    "引言": ["概述", "背景", "介绍", "简介"],
    "范围": ["适用范围", "标准范围", "应用范围", "范围与目的", "总则", "目的和范围"],
    "规范性引用文件": ["引用文件", "参考文件", "规范性文件", "引用标准", "参考标准", "规范引用文献", "标准引用"],
    "术语和定义": ["定义与术语", "定义", "术语", "术语定义", "名词解释", "缩略语和术语", "定义与缩略语"],
    "参考文献": ["参考资料", "文献参考", "引用文献", "参考标准列表"],
}
STANDARD_ORDER = ["范围", "规范性引用文件", "术语和定义"]
MAX_DEPTH = 5
# What injectors delete, misname, weaken, and where they prefer to.
INJECTED_MANDATORY = {"前言": ["前言"], "规范性引用文件": ["规范性引用文件"], "术语和定义": ["术语和定义", "术语"], "核心技术要素": ["要求", "性能", "规范", "指标", "试验", "检验", "检测"]}
INJECTED_TITLES = {
    "前言": ["序言", "说明", "编制说明", "引言", "前  言", "标准前言"],
    "引言": ["前言", "概述", "背景", "介绍", "简介"],
    "范围": ["适用范围", "标准范围", "应用范围", "范围与目的", "总则", "目的和范围"],
    "规范性引用文件": ["引用文件", "参考文件", "规范性文件", "引用标准", "参考标准", "规范引用文献", "标准引用"],
    "术语和定义": ["定义与术语", "定义", "术语", "术语定义", "名词解释", "缩略语和术语", "定义与缩略语"],
    "参考文献": ["参考资料", "文献参考", "引用文献", "参考标准列表", "Bibliography"],
}
INJECTED_APPENDIX_TITLES = {
    "规范性": ["附录X（参考性）", "附录X（强制性）", "规范性附录X", "附录X", "附件X（规范性）"],
    "资料性": ["附录X（参考性）", "附录X（信息性）", "资料性附录X", "附录X（说明性）", "附件X（资料性）"],
}
VAGUE = [("应", "尽量"), ("应", "最好"), ("应", "一般"), ("宜", "尽量"), ("宜", "最好"), ("可", "一般")]
SAFETY = ["安全", "防护", "禁止", "危险", "保护", "故障", "泄漏", "爆炸"]
# Standards that do not exist.
FAKE_STANDARDS = ["GB/T 91001—2031 虚构仪表 校准导则", "GB/T 91002—2032 虚构管件 尺寸", "ISO 91003:2033 Invented vessels", "GB 91004—2034 虚构涂层 试验条件"]
# Metric constants.
MISS_DECAY, NOISE_WEIGHT, NOISE_SCALE = 1.0, 0.15, 100.0
