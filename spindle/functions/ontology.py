"""Vocabulary of a knowledge graph: types, relations, patterns and the words that tell them apart."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Task:
    """A kind of sample: the types that its packs must be of (any if empty), and terms that they must have, or may have instead of the type."""

    name: str
    types: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    either: bool = False
    modality: str = "text"


@dataclass(frozen=True)
class Ontology:
    """A profile; the defaults are fixed values of the crop-health domain, given as they must be for equal results."""

    # Types.
    entity_types: tuple[str, ...] = (
        "病害", "虫害", "病原菌", "作物", "生长期", "生物分类", "药剂", "别名", "部位", "时间",
        "危害症状", "形态特征", "发病诱因", "发生时期", "防治要点", "生活习性", "发生规律", "多模态元素", "其他",
    )
    relations: tuple[str, ...] = ("致病", "发生于", "属类隶属", "危害", "使用药剂", "防治", "生命周期", "地理位置")
    core_types: tuple[str, ...] = ("虫害", "病害", "作物", "病原菌", "药剂", "生长期", "生物分类")
    anchor_types: tuple[str, ...] = ("时间", "部位")
    attribute_fields: tuple[str, ...] = ("别名", "形态特征", "危害症状", "发病诱因", "发生时期", "防治要点", "生活习性", "发生规律")
    attribute_hosts: tuple[str, ...] = ("虫害", "病害", "病原菌")
    protected_types: tuple[str, ...] = ("病害", "虫害", "病原菌", "药剂", "生长期", "时间", "多模态元素")
    mergeable_types: tuple[str, ...] = ("作物", "生物分类", "病原菌", "药剂", "病害", "虫害")
    pack_types: tuple[str, ...] = ("病害", "虫害", "病原菌", "药剂", "作物", "部位", "生长期")
    multimodal_type: str = "多模态元素"
    other_type: str = "其他"
    staged_type: str = "虫害"
    alias_field: str = "别名"
    nameless: str = "未命名实体"
    related: str = "相关"
    pictured: str = "图像实体"
    modalities: tuple[str, ...] = ("image", "table", "equation", "header", "page_number")
    # What a name may be stripped of at its ends.
    name_marks: str = " \t\r\n,，。;；:：()（）[]【】<>《》-_/|"
    # Noise.
    noise_types: tuple[str, ...] = ("header", "page_number")
    noise_patterns: tuple[tuple[str, str], ...] = (
        ("none", r"^\s*None\s*$"),
        ("number", r"^\s*\d+\s*$"),
        ("page", r"^\s*第?\s*\d+\s*页\s*$"),
        ("title", r"蔬菜病虫害诊断[与于]防治原色图谱"),
        ("qr", r"(?:QR|qr|二维码|QR码|扫码)"),
        ("path", r"^(?:[A-Za-z]:)?[/\\].+\.(?:jpg|jpeg|png|bmp|gif|webp|tiff?)\s*$"),
    )
    qr_pattern: str = r"(?:qr|qrcode|二维码|条形码|支付码|扫码)"
    qr_path_pattern: str = r"(?:qr|qrcode|二维码)"
    image_noise_patterns: tuple[str, ...] = (
        r"(二维码|QR\s*码|qrcode|qr\s*code|条形码|barcode|扫码|扫一扫)",
        r"(页眉|页码|第\s*\d+\s*页|^\s*\d+\s*$|page\s*\d+)",
        r"蔬菜病虫害诊断[与于]防治原色图谱",
    )
    path_only_pattern: str = r"^\s*(?:[A-Za-z]:)?[\\/].+\.(?:png|jpe?g|webp|bmp|gif|tiff?)\s*$"
    # Relation, type of the source, type of the target.
    pairs: tuple[tuple[str, str, str], ...] = (
        ("致病", "病原菌", "病害"),
        ("致病", "虫害", "病害"),
        ("发生于", "病害", "时间"),
        ("发生于", "虫害", "时间"),
        ("发生于", "病害", "生长期"),
        ("发生于", "虫害", "生长期"),
        ("发生于", "病害", "部位"),
        ("发生于", "虫害", "部位"),
        ("危害", "病害", "作物"),
        ("危害", "虫害", "作物"),
        ("危害", "病害", "部位"),
        ("危害", "虫害", "部位"),
        ("防治", "病害", "药剂"),
        ("防治", "虫害", "药剂"),
        ("防治", "药剂", "病害"),
        ("防治", "药剂", "虫害"),
    )
    always_allowed: str = "属类隶属"
    # Stages of life, and a pattern of further ones.
    stages: tuple[str, ...] = ("低龄幼虫", "高龄幼虫", "老熟幼虫", "越冬成虫", "越冬幼虫", "越冬卵", "越冬蛹", "成虫", "幼虫", "若虫", "虫卵", "卵", "蛹")
    stage_pattern: str = "[一二三四五六七八九十0-9]+龄幼虫"
    # Parts of plants, endings of short names of parts, groups of crops, endings of names of groups.
    plant_parts: tuple[str, ...] = (
        "心叶", "叶片", "叶面", "叶背", "叶缘", "叶柄", "叶脉", "叶肉", "嫩叶", "老叶", "子叶", "真叶", "根", "根部", "根系", "主根", "须根",
        "茎", "茎部", "茎基部", "茎秆", "花", "花蕾", "花序", "花器", "果实", "果荚", "种子", "嫩梢", "生长点", "顶芽", "侧芽",
    )
    part_ending: str = "部位"
    part_letters: str = "[叶根茎花芽]$"
    crop_groups: tuple[str, ...] = (
        "蔬菜", "蔬菜作物", "十字花科蔬菜", "十字花科植物", "旋花科蔬菜", "旋花科植物", "茄科蔬菜", "茄科植物", "葫芦科蔬菜", "葫芦科植物",
    )
    taxonomy_pattern: str = r"(界|门|纲|目|科|属|种|亚种|变种|族)$"
    composite_pattern: str = r"(科|属|目|纲|门)(植物|蔬菜)$"
    group_pattern: str = r"(蔬菜|植物|作物)$"
    group_words: tuple[str, ...] = ("十字花科", "旋花科")
    # Relation by the first row with a word in the text; order decides.
    relation_words: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("属类隶属", ("belongs_to", "part_of", "contained_in", "属于", "隶属", "属类", "从属", "subordinate")),
        ("致病", ("pathogen", "致病菌", "致病")),
        ("发生于", ("growth stage", "生长期", "发生时期", "period", "history", "record time", "时间", "危害部位", "发病部位", "侵染部位", "部位", "site", "plant part")),
        ("防治", ("control", "prevention", "management", "防治")),
        ("危害", ("impact", "affect", "cause", "damage", "危害", "为害")),
        ("生命周期", ("life cycle", "lifecycle", "stage", "overwinter", "生命周期")),
        ("地理位置", ("地理位置", "地理分布", "分布于", "地区", "省", "市", "县", "region", "page ")),
    )
    # Words by which a relation says that two names are of one thing.
    alias_words: tuple[str, ...] = ("alias", "same as", "sameas", "aka", "别名", "又称", "简称", "俗称")
    # Attribute field by the first row with a word in the text.
    attribute_words: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("形态特征", ("形态", "morphology")),
        ("危害症状", ("症状", "symptom", "damage", "危害")),
        ("发病诱因", ("诱因", "cause", "trigger")),
        ("发生时期", ("时期", "生长期", "时间", "life cycle", "lifecycle")),
        ("防治要点", ("防治", "药剂", "control", "prevention", "treatment")),
        ("生活习性", ("习性", "habit")),
        ("发生规律", ("发生规律", "规律", "occurrence")),
    )
    # Terms that are too general to find a quote by, and terms that make a sentence a better quote.
    generic_terms: tuple[str, ...] = ("相关", "症状", "危害", "防治", "发生", "药剂", "识别", "诊断", "方法", "用法")
    hint_terms: tuple[str, ...] = ("症状", "危害", "防治", "药剂", "病斑", "叶片", "倍液", "幼虫", "成虫", "喷雾", "轮作")
    # Kinds of samples.
    tasks: tuple[Task, ...] = (
        Task("病虫害诊断", ("病害", "虫害"), ("症状", "危害", "发生")),
        Task("防治建议", ("病害", "虫害"), ("防治", "清除", "轮作", "药剂")),
        Task("药剂推荐", ("药剂",), ("药剂", "倍液", "乳油", "悬浮剂", "可湿性粉剂"), either=True),
        Task("症状识别", ("病害", "虫害"), ("症状", "病斑", "叶片", "危害")),
        Task("证据不足", ("病害", "虫害", "药剂")),
        Task("图像问答", modality="image"),
    )
    canonical_language: str = "zh"
    extra: dict = field(default_factory=dict, hash=False, compare=False)


DEFAULT = Ontology()
