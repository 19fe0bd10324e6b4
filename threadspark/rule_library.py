"""The review rule library: 16 categories and their numbered rules.

Fixed values: the wording and the order are data that results depend on.
"""

RULES_VERSION = "2026.07"

# Category id -> (title, rule texts in item order).
RULE_LIBRARY = {
    "R01": (
        "违法违规信息",
        [
            "内容涉及违禁品、毒品、管制刀具、假证件、考试答案或其他违法交易信息。",
            "内容涉及赌博推广、诈骗、虚假抽奖、冒充官方收费或来历不明的募资信息。",
            "内容泄露了他人的姓名、住址、电话、学校、工作单位、证件信息或其他非公开个人资料。",
            "内容涉及人肉搜索、开盒、公开私人账号或其他侵犯个人隐私的行为。",
            "内容提供、传播或索取盗版影片、漫画、音乐、破解程序、付费内容泄露等非法资源。",
            "内容存在其他明显违法风险，具体原因请查看吧务补充说明。",
        ],
    ),
    "R02": (
        "色情、性暗示与低俗内容",
        [
            "内容直接展示性器官、性行为，或明显以色情刺激为主要目的。",
            "内容涉及色情交易、约炮、色情群组或其他不正当交友信息。",
            "内容对现实未成年人或明确设定为未成年人的角色进行色情化、性化或明显性暗示展示。",
            "内容包含偷拍、走光、隐私部位或其他侵犯个人隐私的图片、视频。",
            "帖子使用了与主题无关的性感图片、性暗示标题或擦边封面吸引点击。",
            "帖子使用了与主题无关的色情、性感或擦边图片作为镇楼图。",
        ],
    ),
    "R03": (
        "人身攻击、侮辱与群体攻击",
        [
            "内容包含针对具体用户的辱骂、嘲讽、诅咒或人格贬损。",
            "内容包含针对演员、制作人员、创作者或其他现实人物的辱骂和人身攻击。",
            "内容以地域、民族、国家、性别、年龄、职业、外貌等身份特征攻击他人。",
            "内容将正常观点分歧上升为对他人人格、智力、道德或现实生活的评价。",
            "内容使用侮辱性、贬损性或歧视性称呼评价其他用户或群体。",
            "内容使用“XX孝子”“XX批”“XX小鬼”“XX结晶”等标签称呼或评价他人。此类称呼仅允许用于自称。",
            "内容无依据地将他人称为水军、黑子、串子、洗地、收钱办事或带节奏。",
            "内容将个别用户的言论扩大为对整个作品粉丝、演员粉丝或其他群体的攻击。",
        ],
    ),
    "R04": (
        "挑衅、钓鱼、骚扰与引战",
        [
            "内容明显以激怒他人、诱导争吵或测试他人反应为主要目的。",
            "内容使用“谁急了”“破防了”“孝子来洗地了”等说法故意扩大争端。",
            "内容故意在特定作品、角色、演员或粉丝相关帖子下发表挑衅言论。",
            "标题或正文通过侮辱性措辞、夸张结论或明显贬低制造冲突。",
            "内容反复挑起近期已经多次引发争吵的相同话题。",
            "在吧务提醒、劝阻或相关争论已经结束后，仍继续拱火或扩大冲突。",
            "内容通过连续回复、反复@、追帖或跨帖追逐等方式骚扰特定用户。",
            "内容借“开玩笑”“反串”之名进行实际的人身攻击、挑衅或引战。",
        ],
    ),
    "R05": (
        "挂人、公开围攻与跨平台纠纷",
        [
            "帖子公开了其他用户的账号、主页、聊天记录或发言截图，并可能引导围攻。",
            "帖子以“曝光”“避雷”等名义公开处刑普通观点争议中的用户。",
            "帖子将其他贴吧、群聊、视频平台或社交软件中的普通用户纠纷搬入本吧扩大冲突。",
            "帖子借作品、角色或演员争议，对具体用户进行羞辱、围攻或持续追责。",
            "举报、投诉或侵权证据应提交吧务处理，不应直接公开发动围攻。",
            "帖子公开举证时没有遮挡无关用户的个人信息或隐私内容。",
        ],
    ),
    "R06": (
        "广告、交易、引流与刷屏",
        [
            "内容属于未经允许的商品推销、代购、收费服务、店铺宣传或账号交易。",
            "内容以加群、扫码、关注站外账号、私信联系等方式进行引流。",
            "内容发布了与本吧主题无关的群号、二维码、邀请码或推广链接。",
            "内容属于未经吧务同意的成员招募、问卷调查、社群宣传、活动推广或宣群。",
            "内容在短时间内重复发布相同或高度相似的帖子、回复，影响正常浏览。",
            "内容被删除后仅更换标题、图片、账号或少量文字再次发布，没有进行实质修改。",
            "内容属于重复发布的广告、交易或引流信息。",
        ],
    ),
    "R07": (
        "求资源、水帖与低信息内容",
        [
            "帖子单纯索要盗版影片、漫画、音乐、字幕、网盘、破解资源或其他非法资源。",
            "帖子只有表情、单字、无关图片或纯情绪表达，没有明确的讨论内容。",
            "帖子只写“怎么看”“完了”“是真的吗”等模糊内容，没有提供必要背景。",
            "帖子缺少作品名称、人物、集数、图片或其他必要信息，无法判断具体问题。",
            "帖子内容已在置顶帖、入坑指南、官方水帖或常见问题中明确说明。",
            "内容属于求互粉、求点赞、求投票、求播放量或其他数据互助。",
            "帖子属于毫无依据的预测、无意义排名或只有投票选项而没有讨论内容的低信息帖子。",
        ],
    ),
    "R08": (
        "主题无关、发错分区与重复主题",
        [
            "帖子内容与假面骑士、相关演员、制作信息、官方活动或本吧允许讨论的特摄内容无明确关联。",
            "该内容属于假面骑士周边展示或周边咨询，应发布至假面骑士周边专区。",
            "该内容属于其他特摄作品，应发布至其他特摄专区。",
            "该内容属于普通商品、店家、交易、维修或玩具咨询，应发布至周边专区或指定集中帖。",
            "标题与正文内容明显不符，或标题存在明显夸大和误导。",
            "标题或正文信息不完整，无法判断讨论对象或发帖目的。",
            "近期已有内容高度相同的帖子，请在原帖继续讨论。",
            "该话题已有集中讨论帖，请移步对应集中帖。",
            "相同内容将根据发布时间、信息完整度、讨论热度和内容价值保留其中一帖。",
        ],
    ),
    "R09": (
        "虚假情报、来源不明与误导内容",
        [
            "帖子将个人推测、网友爆料或无法验证的消息作为官方确定情报发布。",
            "帖子发布未证实消息，但没有标注“传闻”“未证实”或“个人推测”。",
            "帖子使用“官宣”“实锤”“已经确定”等措辞包装没有可靠来源的信息。",
            "内容包含伪造的官方截图、海报、字幕、数据、采访或社交平台发言。",
            "内容继续传播已经被官方或可靠来源证伪的消息。",
            "内容通过截取局部信息、删除上下文、错误翻译或误导性剪辑改变原意。",
            "内容对演员、制作人员、吧友或其他现实人物作出缺乏证据的严重指控。",
            "帖子指控他人抄袭、收钱、违法、作弊或存在严重私生活问题，但没有提供可核实的依据。",
        ],
    ),
    "R10": (
        "搬运、版权与AI生成内容",
        [
            "帖子搬运图片、文章、翻译、视频或情报，但没有标注原作者、原平台或原始来源。",
            "帖子擅自去除水印、冒充原创，或将他人作品标为自己的作品。",
            "帖子未经说明转载他人的完整翻译、长文、视频或创作内容。",
            "帖子使用AI生成的图片、台词、截图、新闻、设定或视频，但没有明确标注“AI生成”。",
            "帖子将AI生成内容包装成官方素材、真实截图或真实消息。",
        ],
    ),
    "R11": (
        "剧透内容",
        [
            "标题直接透露了重要身份、死亡、结局、变身、反转、最终形态或其他关键剧情。",
            "内容在剧透保护期内讨论重要剧情，但没有添加剧透提示或进行必要遮挡。",
            "封面图、首图或缩略内容直接展示关键剧透，绕过了剧透提示。",
            "内容涉及最新一集、剧场版、舞台剧或未正式公开剧情，但没有遵守对应的临时剧透规则。",
            "帖子在与剧情无关的讨论中突然透露关键剧情，严重影响他人观看体验。",
        ],
    ),
    "R12": (
        "作品、角色、演员与平台相关不当讨论",
        [
            "内容只有对作品、角色或演员的辱骂性结论，没有具体分析或讨论内容。",
            "内容通过贬低另一部作品、角色、演员或观众群体，抬高自己支持的对象。",
            "内容把作品评价转化为对观众、演员粉丝或其他用户的人身攻击。",
            "内容无依据地指控作品抄袭、演员失德、制作组收钱或平台暗箱操作。",
            "内容恶意中伤其他平台，或将其他平台的普通事务搬入本吧制造冲突。",
            "内容使用作品喜好判断他人的人格、审美、智力或真实立场。",
            "正常的负面评价和作品批评本身不违规；本帖因出现了具体的攻击、造谣、拉踩或引战行为而被删除。",
        ],
    ),
    "R13": (
        "在播作品与完结作品质量比较",
        [
            "比较双方所处的播出阶段不对应。",
            "帖子使用在播作品当前阶段，与其他作品完整季度、完整作品或累计多个季度进行不对等比较。",
            "帖子在当前季度尚未结束前，发布整季或整部作品的绝对质量比较。",
            "帖子使用“令和最强”“令和最差”“大小号XX”“能否超越XX”等结论式说法进行作品质量比较。",
            "帖子表面讨论已完结作品，实际内容明显用于影射、旁敲侧击或拉踩当前在播作品。",
            "帖子借首集、强化回、过渡回、最终登场回等单集表现，直接扩大为整部作品的绝对质量结论。",
            "帖子比较的单集类型、剧情阶段或制作条件不对应。",
            "帖子借作品质量比较攻击演员、制作人员、观众或粉丝群体。",
            "帖子只有“谁更好”“谁赢了”的结论，没有说明剧情、摄影、动作、皮套、音乐或角色塑造等比较范围。",
            "该质量比较应等待当前作品对应季度结束后再进行。",
            "当前话题涉及在播作品与已完结作品的整体质量比较，不属于现阶段允许的比较范围。",
            "在播作品出现已完结作品相关角色、设定或回归内容时可以讨论对应内容，但本帖借此进行了整体质量拉踩。",
        ],
    ),
    "R14": (
        "战力对比与设定讨论",
        [
            "帖子只提出“谁更强”“谁秒谁”，没有提供比较标准、设定依据或具体分析。",
            "帖子制作了完全依据个人喜好的绝对强弱榜、秒杀论或结论式排名。",
            "帖子无视不同作品的世界观、能力规则和设定差异，进行绝对化跨作品比较。",
            "帖子借战力比较拉踩作品、角色、演员或粉丝群体。",
            "近期已有相同战力争议话题，请在原帖或集中帖继续讨论。",
            "帖子将娱乐性质的脑洞或假设包装成官方确定结论。",
            "帖子在存在明确官方数据、设定资料或剧情表现时，仍以纯粹喜好代替事实依据。",
            "正常的角色能力、设定机制、剧情表现和官方数据讨论不违规；本帖因缺少基本分析或引发重复争议而被删除。",
        ],
    ),
    "R15": (
        "旧帖挖坟",
        [
            "回复没有提供新情报、纠错、补充资料或实质观点，仅将长期无人讨论的旧帖重新顶起。",
            "回复只有“顶”“路过”“哈哈”“现在还有人吗”等无新增信息内容。",
            "该旧帖内容已经过时或结论失效，继续回复容易造成误导。",
            "该话题需要结合最新情况重新讨论，请另开新帖并补充新的信息。",
        ],
    ),
    "R16": (
        "吧务管理与其他违规",
        [
            "该内容应发布至官方水帖、集中讨论帖、申诉帖或其他指定位置。",
            "内容违反了当前置顶的临时管理公告，具体规定请查看对应公告。",
            "内容属于重复发布相同申诉、持续骚扰吧务或组织用户冲击管理页面。",
            "内容伪造吧务通知、冒充吧务发布规则、处罚、公告或虚假处理结果。",
            "对吧务的意见和质疑本身不违规；本帖因包含人身攻击、造谣、刷屏或恶意骚扰而被删除。",
            "内容存在现有选项无法完整概括的其他违规情况，具体原因请查看吧务补充说明。",
        ],
    ),
}
