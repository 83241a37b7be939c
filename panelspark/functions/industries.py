"""Industry classifications of the first level as dictionaries of code and name."""

# Codes and names.
SW = {
    "801010": "农林牧渔", "801020": "采掘", "801030": "化工", "801040": "钢铁", "801050": "有色金属",
    "801080": "电子", "801110": "家用电器", "801120": "食品饮料", "801130": "纺织服装", "801140": "轻工制造",
    "801150": "医药生物", "801160": "公用事业", "801170": "交通运输", "801180": "房地产", "801200": "商业贸易",
    "801210": "休闲服务", "801230": "综合", "801710": "建筑材料", "801720": "建筑装饰", "801730": "电气设备",
    "801740": "国防军工", "801750": "计算机", "801760": "传媒", "801770": "通信", "801780": "银行", "801790": "非银金融",
    "801880": "汽车", "801890": "机械设备", "801060": "建筑建材", "801070": "机械设备", "801090": "交运设备",
    "801190": "金融服务", "801100": "信息设备", "801220": "信息服务",
}
CS = {
    "CI005001": "石油石化", "CI005002": "煤炭", "CI005003": "有色金属", "CI005004": "电力及公用事业", "CI005005": "钢铁",
    "CI005006": "基础化工", "CI005007": "建筑", "CI005008": "建材", "CI005009": "轻工制造", "CI005010": "机械",
    "CI005011": "电力设备", "CI005012": "国防军工", "CI005013": "汽车", "CI005014": "商贸零售", "CI005015": "餐饮旅游",
    "CI005016": "家电", "CI005017": "纺织服装", "CI005018": "医药", "CI005019": "食品饮料", "CI005020": "农林牧渔",
    "CI005021": "银行", "CI005022": "非银行金融", "CI005023": "房地产", "CI005024": "交通运输", "CI005025": "电子元器件",
    "CI005026": "通信", "CI005027": "计算机", "CI005028": "传媒", "CI005029": "综合",
}
WIND = {
    "882002": "材料", "882001": "能源", "882003": "工业", "882004": "可选消费", "882005": "日常消费",
    "882006": "医疗保健", "882007": "金融", "882008": "信息技术", "882009": "电信服务",
    "882010": "公用事业", "882011": "房地产",
}


def reverse_of(names: dict[str, str]) -> dict[str, str]:
    """Codes by name; of several codes the last."""
    return {v: k for k, v in names.items()}
