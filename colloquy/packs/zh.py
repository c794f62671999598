"""The Chinese rule pack.

Fixed values: every list, pattern and format below has to be exactly this for
results to agree with the rules it describes.
"""

from colloquy.packs.base import DuePhrase, RulePack, TaskPattern

_DUE = (
    "[\\d年月日周一二三四五六天]+|下周一|本周[一二三四五六日天]|月底|月末"
    "|周[一二三四五六日天]|下周[一二三四五六日天]|今天|明天|后天"
)
_DO = "负责|跟进|处理|完成|做|解决|优化|开发|推进|落实|编写|整理"
_DO_YOU = "负责|跟进|处理|完成|推进|落实"
_REST = "[^，。；！？\\n]"
_HAN = "[\\x{4e00}-\\x{9fff}]"
_HAN_NAME = "[\\x{4e00}-\\x{9fa5}]"
_SURNAMES = (
    "张李王赵刘陈杨黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
    "苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史"
    "顾侯邵孟龙万段漕钱汤尹黎易常武乔贺赖龚文"
)
_TITLED = "张李王赵刘陈杨黄周吴"

ZH = RulePack(
    name="zh",
    sentence_break="[。！？!?；;\\n\\r]+",
    clause_break="[，,]+",
    trim_chars=" ，,\t",
    stop_mark="。",
    final_marks=("。", "！", "？", ".", "!", "?"),
    script_char=_HAN,
    token="[\\x{4e00}-\\x{9fff}]{2,}|[A-Za-z]{3,}",
    topic_token="[\\x{4e00}-\\x{9fff}]{2,8}|[A-Za-z]{4,20}",
    keyword_token="[\\x{4e00}-\\x{9fff}]{2,6}",
    fillers=(
        "ok", "okay", "嗯", "啊", "哦", "额", "呃", "哈", "好的", "可以", "行", "收到", "明白",
        "听得到", "听得到吗", "喂", "是的", "对", "对的", "好", "嗯嗯",
    ),
    important=(
        "公司", "方案", "计划", "项目", "任务", "安排", "需要", "问题", "风险", "成本", "预算",
        "招聘", "人员", "宿舍", "住宿", "负责", "完成", "推进", "确认", "截止", "时间", "目标",
    ),
    important_regex="(本周|下周|今天|明天|\\d{1,2}月\\d{1,2}日|周[一二三四五六日天]|截止|之前)",
    block_joiner="，",
    topic_stop=(
        "我们", "你们", "他们", "这个", "那个", "这里", "那边", "然后", "而且", "如果", "因为", "所以",
        "就是", "还是", "可能", "感觉", "问题", "事情", "内容", "情况", "时候", "方面", "一下", "一个",
        "可以", "没有", "不是", "需要", "进行", "相关", "以及", "已经", "目前", "这个事",
    ),
    topic_stop_lower=(
        "the", "and", "for", "with", "that", "this", "from", "they", "will", "have", "were", "been",
        "about", "your", "you", "our", "are", "was", "is", "to", "of", "in", "on", "at", "it", "as",
        "an", "or", "we", "i", "a", "uh", "um", "yeah", "ok", "okay", "like", "just", "really", "very",
        "there", "here", "then",
    ),
    keyword_stop=(
        "我们", "你们", "他们", "这个", "那个", "现在", "然后", "就是", "因为", "所以", "一个", "没有",
        "可以", "还是", "比较", "公司", "问题", "东西", "时候", "这种", "工作", "员工", "安排", "负责",
        "时间", "这里", "那边", "这样", "的话",
    ),
    stopwords=(
        "的", "了", "是", "在", "和", "与", "及", "或", "等", "对", "对于", "把", "被", "让", "给", "由",
        "以", "向", "从", "为", "为了", "因为", "所以", "但是", "然而", "可是", "不过", "只是", "就是",
        "还是", "而且", "并且", "或者", "如果", "那么", "即使", "虽然", "尽管", "无论", "不管", "这", "那",
        "你", "我", "他", "她", "它", "们", "这个", "那个", "这些", "那些", "这里", "那里", "这样", "那样",
        "这么", "怎么", "什么", "如何", "为何", "谁", "哪", "几", "多少", "地", "得", "着", "过", "吧", "吗",
        "呢", "啊", "呀", "哇", "哈", "哦", "嗯", "呃", "可以", "能够", "应该", "必须", "需要", "可能", "会",
        "能", "要", "就", "都", "也", "还", "又", "再", "很", "太", "更", "最", "非常", "特别", "十分",
        "比较", "稍微", "有点", "一些", "一点", "个", "种", "类", "方式", "方法", "问题", "任务", "工作",
        "项目", "时间", "时候", "今天", "明天", "昨天", "现在", "未来", "之前", "之后", "同时", "期间",
    ),
    topic_rules=(
        ("接口联调", ("接口", "联调")),
        ("测试安排", ("测试", "回归", "用例")),
        ("任务分工", ("负责", "分工", "安排")),
        ("时间节点", ("截止", "周一", "周二", "周三", "周四", "周五", "时间")),
        ("模块优先级", ("先完成", "优先", "支付", "报表")),
        ("用工与招聘", ("招聘", "中介", "派遣", "员工")),
        ("薪资与加班", ("工资", "加班", "时薪", "补贴")),
        ("住宿与福利", ("住宿", "饭卡", "福利", "补助")),
        ("工作强度", ("压力", "夜班", "流水线", "环境")),
    ),
    topic_skip=("负责", "安排", "时间", "问题", "公司", "我们"),
    positive=(
        "好", "顺利", "成功", "优秀", "满意", "高兴", "开心", "棒", "完美", "出色", "进步", "提升", "改善",
        "解决", "完成", "通过", "批准", "同意", "支持", "赞赏", "表扬", "恭喜", "突破", "创新", "高效", "优质",
    ),
    negative=(
        "问题", "困难", "失败", "糟糕", "不满意", "难过", "失望", "错误", "缺陷", "崩溃", "延迟", "滞后",
        "缓慢", "复杂", "混乱", "冲突", "反对", "拒绝", "批评", "投诉", "麻烦", "担忧", "担心", "焦虑",
    ),
    redundant=(
        "呃", "嗯", "啊", "哎", "哦", "唔", "这个", "那个", "就是", "就是说", "然后", "所以", "的话",
        "实际上", "基本上", "其实",
    ),
    punctuation=(
        (",", "，"), (".", "。"), ("?", "？"), ("!", "！"), (":", "："), (";", "；"), ("(", "（"),
        (")", "）"), ("[", "【"), ("]", "】"),
    ),
    ordinals=("首先", "然后", "最后"),
    question_words=("吗", "呢", "吧", "什么", "怎么", "如何", "是否", "谁", "哪", "几", "多少"),
    doubled=(
        "这个这个", "那个那个", "然后然后", "就是就是", "对对对", "是是是", "好好好", "嗯嗯嗯", "呃呃呃",
    ),
    decision_marks=("决定", "确定", "通过", "拍板", "达成", "同意"),
    issue_marks=(
        "待确认", "未确定", "尚未", "还需要", "仍需", "未落实", "未完成", "无法", "不能", "缺少", "风险",
        "阻塞", "卡点", "争议", "不明确", "没定", "未达成",
    ),
    issue_context=(
        "方案", "资源", "时间", "成本", "预算", "招聘", "住宿", "接口", "测试", "排期", "环境", "人员", "责任",
    ),
    issue_noise=(
        "的话", "就是", "然后", "这个", "那个", "听一下", "你知道", "有点", "比较", "什么的", "这块", "那块",
    ),
    action_regex="([\\x{4e00}-\\x{9fff}]{2,6})负责([^，。；;]{2,40})",
    action_due_regex="(周[一二三四五六日天][^，。；; ]*)",
    action_owner_block=("我们", "你们", "他们", "公司", "大家", "这个", "那个"),
    action_link="负责",
    lead_fillers=("好的", "嗯", "啊", "然后", "就是", "这个", "那个", "所以", "那就", "其实"),
    task_patterns=(
        TaskPattern(
            f"^(?:请|由|让)?\\s*({_HAN_NAME}{{2,4}})(?:同学|老师|经理|总)?(?=[，,\\s]*(?:{_DO}))"
            f"[，,\\s]*(?:{_DO})\\s*({_REST}{{2,50}})(?:[，,].*)?$",
            owner=1, task=2, names_assignee=True,
        ),
        TaskPattern(
            f"^(?:[\\x{{4e00}}-\\x{{9fa5}}A-Za-z]{{0,8}})?(?:需要|要|必须|请)\\s*({_REST}{{2,50}}?)(?:在|于|截止)?"
            f"\\s*({_DUE})[\\s]*(?:前|之前|完成|提交|准备|上线).*$",
            task=1, due=2,
        ),
        TaskPattern(
            f"^({_HAN_NAME}{{2,4}})(?=[，,\\s]*(?:你|您)[\\s]*(?:{_DO_YOU}))[，,\\s]*(?:你|您)[\\s]*"
            f"(?:{_DO_YOU})\\s*({_REST}{{2,50}})(?:[，,].*)?$",
            owner=1, task=2, names_assignee=True,
        ),
        TaskPattern(f"^(?:任务|todo|待办)[：:]\\s*({_REST}{{2,50}})$", task=1),
        TaskPattern(
            f"^({_DUE})[\\s]*(?:前|之前)[\\s]*(?:完成|提交|准备|上线)[\\s]*({_REST}{{2,50}})$",
            due=1, task=2,
        ),
        TaskPattern(
            f"^([\\x{{4e00}}-\\x{{9fa5}}A-Za-z]{{2,8}})(?:要|需|需要)?在\\s*({_DUE})[\\s]*(?:前|之前)?"
            f"(?:完成|提交|准备|上线)\\s*({_REST}{{2,50}})$",
            owner=1, due=2, task=3,
        ),
    ),
    task_verbs="(负责|完成|提交|跟进|处理|优化|安排|准备|解决|推进|落实|编写|整理)",
    task_noise=(
        "的话", "就是", "然后", "你知道", "听一下", "有点", "比较", "这种", "那个", "这个", "也是因为",
        "没有给你", "有没有给", "题还是给", "公司就占", "天都重复", "月就必须",
    ),
    owner_link="负责",
    due_open="（截止",
    due_close="）",
    assignee_regex="^[A-Za-z\\x{4e00}-\\x{9fa5}]{2,8}$",
    assignee_block=(
        "我们", "你们", "他们", "公司", "大家", "这个", "那个", "项目", "团队", "部门", "也是因为", "我不给你",
        "是怎么", "是怎麽", "没有给到", "给你自己", "是自己", "有没有给", "月就必须", "天都重复", "公司就占",
        "题还是给", "其实", "虽然", "没有给你",
    ),
    assignee_noise=(
        "因为", "怎么", "怎麽", "然后", "如果", "可以", "自己", "有没有", "还是", "虽然", "必须", "就是",
        "现在", "那个", "这个", "没有给", "给你", "公司", "重复",
    ),
    due_phrases=(
        DuePhrase("本周五", "weekday", "FRI"),
        DuePhrase("周五", "weekday", "FRI"),
        DuePhrase("下周三", "weekday_after", "WED"),
        DuePhrase("下周一", "weekday_after", "MON"),
        DuePhrase("月底", "month_end"),
    ),
    high=("紧急", "立刻", "马上", "尽快", "高优先级", "urgent", "asap", "immediately"),
    medium=("重要", "关键", "优先", "important", "critical", "priority"),
    score_verbs=("负责", "跟进", "处理", "完成", "做", "解决", "优化", "开发"),
    refine_block=(
        "我们", "你们", "他们", "公司", "大家", "这个", "那个", "这里", "那边", "然后", "而且", "如果", "因为",
        "we", "you", "they", "team", "company",
    ),
    refine_noise=("如果", "然后", "现在", "可以", "怎么", "比如", "所谓", "对啊", "有些", "们是"),
    refine_function_words=(
        "因为", "没有", "必须", "其实", "还是", "有没有", "虽然", "就是", "然后", "现在", "这个", "那个", "公司",
    ),
    refine_verbs=("负责", "完成", "提交", "跟进", "处理", "优化", "安排", "准备", "解决", "推进", "落实"),
    refine_intents=(
        "请", "需要", "安排", "尽快", "截止", "本周", "下周", "今天", "明天", "确认", "同步",
    ),
    refine_chatter=(
        "的时候", "的话", "比如", "像", "怎么", "可能", "不是很好", "比较难", "也不好", "无论什么",
        "开始负责房子", "没有给到负责", "你自己去负责", "合一些去负责", "部分人来负责", "也比较难负责",
        "景也不好负责",
    ),
    refine_vague=("的时候", "的话", "比如", "像", "怎么", "可能"),
    refine_owner_regex="^([A-Za-z\\x{4e00}-\\x{9fff}]{2,10})负责",
    refine_strict_regex="^([A-Za-z\\x{4e00}-\\x{9fff}]{2,8})负责([\\x{4e00}-\\x{9fff}A-Za-z0-9、，,\\-]{2,40})$",
    refine_word="[A-Za-z]{2,}|[\\x{4e00}-\\x{9fff}]{1,6}",
    due_hint=(
        "本周[一二三四五六日天]|下周[一二三四五六日天]|周[一二三四五六日天]|今天|明天|后天|月底|月末"
        "|\\d{1,2}月\\d{1,2}日|\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}"
    ),
    due_context=("截止", "截至", "之前", "前完成", "前提交", "deadline"),
    name_regex="[\\x{4e00}-\\x{9fff}]{2,3}",
    name_stop=(
        "项目", "会议", "任务", "问题", "时间", "计划", "工作", "开发", "测试", "完成", "处理", "优化", "发布",
        "版本",
    ),
    surnames=f"[{_SURNAMES}]",
    titled_surnames=f"[{_TITLED}]",
    titles_kept=("总", "总监"),
    titles_dropped=("经理", "工程师"),
    org_regexes=(
        "([\\x{4e00}-\\x{9fa5}]{2,}(?:公司|集团|部门|团队|组|委员会|中心|局|处|所|院|系|室|厂|店))",
        "([\\x{4e00}-\\x{9fa5}]{2,}(?:科技|技术|信息|网络|软件|硬件|电子|通信)有限公司?)",
    ),
    date_regexes=(
        "\\d{4}年\\d{1,2}月\\d{1,2}日", "\\d{4}-\\d{1,2}-\\d{1,2}", "\\d{1,2}月\\d{1,2}日",
        "本周[一二三四五六日]", "下周[一二三四五六日]", "下个月", "月底", "月末", "Q[1-4]", "第[一二三四]季度",
    ),
    time_regexes=(
        "今天|明天|昨天|前天|后天", "本周[一二三四五六日]", "下周[一二三四五六日]", "下个月", "月底|月末",
        "Q[1-4]|第[一二三四]季度",
    ),
    entity_task_regexes=(
        f"([{_TITLED}][^，,。；;、]{{1,2}})(?:经理|工程师|总|总监)?[:：]?\\s*(?:负责|处理|完成|解决|跟进|执行)"
        "([^。]+?)(?:[，。；！？]|$)",
        "(需要|要|应该|必须)([^。]+?)(完成|解决|处理|跟进|执行)(?:[，。；！？]|$)",
        f"([^，。]{{2,20}})由([{_TITLED}][^，,。；;、]{{1,2}})负责",
    ),
    refusals=(
        "我是(一个)?AI", "无法(访问|处理)", "抱歉", "请提供(更多|完整)信息", "作为(一个)?语言模型",
    ),
    summary_parts=("会议重点讨论了%s", "识别到%d项待跟进行动", "提取到%d条决策线索"),
)
